"""No streaming operators: a Gram matrix adds up over rows only once column means and deviations are fixed, so a stream
of counts has to be stored and the batch plan run over what is stored."""
