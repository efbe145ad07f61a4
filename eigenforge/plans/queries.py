"""Registered queries of the matrix operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.config import Config
from eigenforge.functions.rng import PRIME, permute_rows
from eigenforge.operators import blocks, normalize, perturb, qc, rmt, robust, sparsity, spectrum, tiles
from eigenforge.plans import significance
from eigenforge.session import materialize
from eigenforge.sources.matrix import CountMatrix

SEED = 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(c: Column | str, digits: int = 5) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# Fixtures: supplier x part, customer x (brand, type), user x hour, document x word, labelled vectors.


def supplier_part(spark, sf_dir) -> CountMatrix:
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene"))
    m = CountMatrix.from_ids(rows)
    return CountMatrix(m.expr, m.cells, names)


def customer_kind(spark, sf_dir) -> CountMatrix:
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.concat_ws("/", "p_brand", "p_type")
    return CountMatrix.from_long(spark, lines, F.lpad(F.col("o_custkey").cast("string"), 12, "0"), kind, F.col("l_quantity"))


def user_hour(spark, sf_dir) -> CountMatrix:
    rows = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id"), F.floor(F.unix_timestamp("ts") / 3600).alias("gene_id")).agg(F.count(F.lit(1)).alias("value"))
    return CountMatrix.from_ids(rows)


def document_word(spark, sf_dir) -> CountMatrix:
    words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''")
    return CountMatrix.from_long(spark, words, F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.col("word"), F.lit(1))


def vectors(spark, sf_dir) -> DataFrame:
    """Labelled vectors as repeats of components: the label is the repeat, the place within it the component."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return _read(spark, sf_dir, "embeddings").select(F.col("label").alias("rep"), place.alias("comp_idx"), F.col("embedding").cast("array<double>").alias("vec"))


FX1 = "expr AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
FX2 = """raw AS (
  SELECT o_custkey AS c, concat_ws('/', p_brand, p_type) AS g, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
expr AS (SELECT dense_rank() OVER (ORDER BY c) - 1 AS cell_id, dense_rank() OVER (ORDER BY g) - 1 AS gene_id, value FROM raw)"""
FX3 = "expr AS (SELECT user_id AS cell_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS gene_id, count(*) AS value FROM events GROUP BY 1, 2)"
FX5 = "vec AS (SELECT label AS rep, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS comp_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: The normalisation by its definition, on the whole grid.
NORM = """cl AS (SELECT DISTINCT cell_id FROM expr), gn AS (SELECT DISTINCT gene_id FROM expr),
k AS (SELECT (SELECT count(*) FROM cl) AS n, (SELECT count(*) FROM gn) AS m),
s AS (SELECT cell_id, gene_id, ln(1 + value / sum(abs(value)) OVER (PARTITION BY cell_id)) AS s FROM expr),
g0 AS (SELECT cl.cell_id, gn.gene_id, coalesce(s.s, 0.0) AS x FROM cl CROSS JOIN gn LEFT JOIN s ON cl.cell_id = s.cell_id AND gn.gene_id = s.gene_id),
mo AS (SELECT gene_id, avg(x) AS mu, stddev_pop(x) AS sd FROM g0 GROUP BY 1),
z AS (SELECT cell_id, g0.gene_id, (x - mu) / sd AS z FROM g0 JOIN mo ON g0.gene_id = mo.gene_id),
l AS (SELECT cell_id, sqrt(sum(z * z)) AS l2 FROM z GROUP BY 1),
y AS (SELECT z.cell_id, gene_id, z / l2 * (SELECT avg(l2) FROM l) AS y FROM z JOIN l ON z.cell_id = l.cell_id),
x AS (SELECT cell_id, gene_id, y - avg(y) OVER (PARTITION BY gene_id) AS value FROM y)"""
GRAM_CELL = "gr AS (SELECT a.cell_id AS i, b.cell_id AS j, sum(a.value * b.value) / (SELECT m FROM k) AS g FROM x a JOIN x b ON a.gene_id = b.gene_id GROUP BY 1, 2)"
GRAM_GENE = "gr AS (SELECT a.gene_id AS i, b.gene_id AS j, sum(a.value * b.value) / (SELECT m FROM k) AS g FROM x a JOIN x b ON a.cell_id = b.cell_id GROUP BY 1, 2)"


def _uniform_sql(tag: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', '{tag}', cell_id, gene_id)), 1, 8) AS BIGINT) / 4294967296.0"


def _filter_sql(cells: str, genes: str) -> str:
    return f"""WITH {FX1},
cs AS (SELECT cell_id, count(*) FILTER (WHERE value <> 0) AS n, sum(value) AS t, sum(CASE WHEN regexp_matches(p_name, '(?i)^[a-d]') THEN value ELSE 0 END) AS p
       FROM expr JOIN part ON gene_id = p_partkey GROUP BY 1),
gs AS (SELECT gene_id, count(*) FILTER (WHERE value <> 0) AS n, sum(value) AS t FROM expr GROUP BY 1),
pc AS (SELECT cell_id FROM cs WHERE {cells}), pg AS (SELECT gene_id FROM gs WHERE {genes})"""


_CELLS, _GENES = "t > 0 AND t < 20000 AND n >= 480 AND n < 530 AND p / nullif(t, 0) < 0.95", "t > 0 AND t < 1e6 AND n >= 25"


@query(f"WITH {FX1} SELECT gene_id, count(*) FILTER (WHERE value <> 0) AS n_cells, sum(value) AS total FROM expr GROUP BY 1")
def gene_stats(spark, sf_dir):
    return qc.gene_stats(supplier_part(spark, sf_dir).expr)


@query(f"WITH {FX1} SELECT cell_id, count(*) FILTER (WHERE value <> 0) AS n_genes, sum(value) AS total FROM expr GROUP BY 1")
def cell_stats(spark, sf_dir):
    return qc.cell_stats(supplier_part(spark, sf_dir).expr)


@query(f"""WITH {FX1} SELECT cell_id, round(sum(CASE WHEN regexp_matches(p_name, '(?i)^[a-d]') THEN value ELSE 0 END) / nullif(sum(value), 0), 5) + 0.0 AS low,
round(sum(CASE WHEN regexp_matches(p_name, '(?i)^RP[SL]') THEN value ELSE 0 END) / nullif(sum(value), 0), 5) + 0.0 AS ribo FROM expr JOIN part ON gene_id = p_partkey GROUP BY 1""")
def ratio_stats(spark, sf_dir):
    m = supplier_part(spark, sf_dir)
    return qc.ratio_stats(m.expr, m.genes, {"low": "(?i)^[a-d]", "ribo": qc.RIBO}).select("cell_id", _r("low").alias("low"), _r("ribo").alias("ribo"))


@query(_filter_sql(_CELLS, _GENES) + " SELECT gene_id FROM pg")
def filter_genes(spark, sf_dir):
    return qc.passing_genes(supplier_part(spark, sf_dir).expr, 0, 1e6, 25)


@query(_filter_sql(_CELLS, _GENES) + " SELECT cell_id FROM pc")
def filter_cells(spark, sf_dir):
    m = supplier_part(spark, sf_dir)
    return qc.passing_cells(m.expr, m.genes, 0, 20000, 480, 530, mito_percent=95.0, mito="(?i)^[a-d]")


@query(_filter_sql(_CELLS, _GENES) + """, kept AS (SELECT * FROM expr WHERE cell_id IN (FROM pc) AND gene_id IN (FROM pg) AND value <> 0)
SELECT cell_id, gene_id, value FROM kept WHERE gene_id IN (SELECT gene_id FROM kept GROUP BY 1 HAVING sum(value) <> 0)""")
def filter_full(spark, sf_dir):
    return qc.filter_cells_and_genes(supplier_part(spark, sf_dir), max_tp_c=20000, max_tp_g=1e6, min_genes_per_cell=480, max_genes_per_cell=530, min_cells_per_gene=25, mito_percent=95.0, mito="(?i)^[a-d]", on_empty="empty").expr


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT CAST(o_custkey AS VARCHAR) AS cell, o_orderpriority AS gene, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2""")
def wide_ingest(spark, sf_dir):
    wide = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("cell")).pivot("o_orderpriority", PRIORITIES).count()
    m = CountMatrix.from_wide(spark, wide)
    return m.expr.join(m.cells, "cell_id").join(m.genes, "gene_id").select("cell", "gene", "value")


@query(f"WITH {FX1}, {NORM} SELECT cell_id, gene_id, round(s, 7) + 0.0 AS s FROM s")
def norm_l1_log(spark, sf_dir):
    return normalize.l1_log(supplier_part(spark, sf_dir).expr).select("cell_id", "gene_id", _r("s", 7).alias("s"))


@query(f"WITH {FX1}, {NORM} SELECT gene_id, round(mu, 8) + 0.0 AS mu, round(sd, 7) + 0.0 AS sd FROM mo")
def zscore_stats(spark, sf_dir):
    m = supplier_part(spark, sf_dir)
    return normalize.gene_moments(normalize.l1_log(m.expr), m.cells.count()).select("gene_id", _r("mu", 8).alias("mu"), _r("sd", 7).alias("sd"))


@query(f"WITH {FX1}, {NORM} SELECT cell_id, round(l2, 5) + 0.0 AS l2 FROM l")
def l2_stats(spark, sf_dir):
    m = supplier_part(spark, sf_dir)
    return normalize.normalize(m.expr, m.cells).cells.select("cell_id", _r("l2").alias("l2"))


@query(f"WITH {FX2}, {NORM} SELECT cell_id, gene_id, round(value, 5) + 0.0 AS value FROM x")
def normalize_full(spark, sf_dir):
    return blocks.dense(spark, _normal(spark, customer_kind(spark, sf_dir))).select("cell_id", "gene_id", _r("value").alias("value"))


def _stored(spark, m: CountMatrix) -> CountMatrix:
    """The same matrix, read once: what follows counts and joins it several times."""
    expr, _ = materialize(spark, m.expr.select("cell_id", "gene_id", "value"), "counts")
    cells, _ = materialize(spark, m.cells.select("cell_id"), "cells")
    return CountMatrix(expr, cells, expr.select("gene_id").distinct())


def _normal(spark, m: CountMatrix):
    """Normalised row blocks."""
    m = _stored(spark, m)
    return blocks.normalize_blocks(spark, blocks.build(spark, m.expr, m.cells, [r[0] for r in m.genes.collect()]))


def _tiles(spark, m: CountMatrix, side: str):
    """The Gram matrix's tiles, the side's ids, cells."""
    m = _stored(spark, m)
    normal = blocks.normalize_blocks(spark, blocks.build(spark, m.expr, m.cells, [r[0] for r in m.genes.collect()]))
    x = tiles.by_cells(normal) if side == "gene" else tiles.by_genes(spark, normal, m.expr)
    out, _ = materialize(spark, tiles.gram_tiles(spark, x, normal.blocks.n_genes), "tiles", large_rows=True)
    return out, x.ids, normal.blocks.n_cells


def _gram_rows(spark, m: CountMatrix, side: str) -> DataFrame:
    found, ids, _ = _tiles(spark, m, side)
    return tiles.gram_rows(found, ids)


def _cell_gram(spark, m: CountMatrix, digits: int = 5) -> DataFrame:
    m = _stored(spark, m)
    n_genes = m.genes.count()
    if n_genes > tiles.GENES_HELD:
        return tiles.gram_of_entries(spark, normalize.normalize(m.expr, m.cells), n_genes, digits)
    genes = m.genes.toArrow()["gene_id"].to_numpy()
    return tiles.gram_of_cells(spark, blocks.normalize_blocks(spark, blocks.build(spark, m.expr, m.cells, genes, block_rows=tiles.PAIR_ROWS)), digits)


def _gram_sums(spark, m: CountMatrix, side: str) -> tuple[int, float, float, int]:
    """Side, sum and sum of squares of the eigenvalues, cells."""
    found, ids, n_cells = _tiles(spark, m, side)
    return len(ids), *tiles.gram_sums(found, len(ids)), n_cells


@query(f"WITH {FX1}, {NORM}, {GRAM_CELL} SELECT i, j, round(g, 5) + 0.0 AS g FROM gr")
def gram_cell(spark, sf_dir):
    return _cell_gram(spark, supplier_part(spark, sf_dir))


@query(f"WITH {FX2}, {NORM}, {GRAM_GENE} SELECT i, j, round(g, 5) + 0.0 AS g FROM gr")
def gram_gene(spark, sf_dir):
    return _gram_rows(spark, customer_kind(spark, sf_dir), "gene").select("i", "j", _r("g").alias("g"))


@query(f"WITH {FX3}, {NORM}, {GRAM_CELL} SELECT i, j, round(g, 5) + 0.0 AS g FROM gr")
def gram_by_join(spark, sf_dir):
    return _cell_gram(spark, user_hour(spark, sf_dir))


@query(f"""WITH {FX3}, {NORM},
d AS (SELECT cell_id, gene_id, value, h2 FROM (SELECT *, (h1 * h1 + 67891) % {PRIME} AS h2 FROM (SELECT *, (h0 * h0 + 12345) % {PRIME} AS h1
  FROM (SELECT *, ((cell_id % {PRIME}) * 48271 + (gene_id % {PRIME}) * 69621 + {SEED}) % {PRIME} AS h0 FROM x)))),
p AS (SELECT cell_id, list(gene_id ORDER BY gene_id) AS genes, list(value ORDER BY h2, gene_id) AS dealt FROM d GROUP BY 1)
SELECT cell_id, gene_id, round(value, 5) + 0.0 AS value FROM (SELECT cell_id, unnest(genes) AS gene_id, unnest(dealt) AS value FROM p)""")
def null_permutation(spark, sf_dir):
    m = user_hour(spark, sf_dir)
    norm = normalize.normalize(m.expr, m.cells)
    return permute_rows(normalize.dense(norm), SEED, norm.genes).select("cell_id", "gene_id", _r("value").alias("value"))


@query(f"""WITH {FX2}, {NORM}, {GRAM_GENE}, t AS (SELECT sum(g) FILTER (WHERE i = j) AS a, sum(g * g) AS b, (SELECT m FROM k) AS d FROM gr)
SELECT d AS n, round(a, 4) + 0.0 AS sum_l, round(b, 3) + 0.0 AS sum_l2 FROM t""")
def spectrum_moments(spark, sf_dir):
    d, trace, squares, _ = _gram_sums(spark, customer_kind(spark, sf_dir), "gene")
    return spark.range(1).select(F.lit(d).cast("long").alias("n"), _r(F.lit(trace), 4).alias("sum_l"), _r(F.lit(squares), 3).alias("sum_l2"))


_MP_SQL = """SELECT round(m1, 4) + 0.0 AS moment_1, round(m2, 4) + 0.0 AS moment_2, round(g, 4) + 0.0 AS gamma, round(m1 * (1 + sqrt(g)) * (1 + sqrt(g)), 4) + 0.0 AS b_plus,
round(m1 * (1 - sqrt(g)) * (1 - sqrt(g)), 4) + 0.0 AS b_minus, round(m1 * (1 - g) * (1 - g) / (1 + g), 4) + 0.0 AS peak FROM (SELECT m1, m2, m2 / (m1 * m1) - 1 AS g FROM mo2)"""


@query(f"""WITH {FX2}, {NORM}, {GRAM_GENE}, mo2 AS (SELECT sum(g) FILTER (WHERE i = j) / (SELECT m FROM k) AS m1, sum(g * g) / (SELECT m FROM k) AS m2 FROM gr) {_MP_SQL}""")
def mp_params(spark, sf_dir):
    d, trace, squares, _ = _gram_sums(spark, customer_kind(spark, sf_dir), "gene")
    return rmt.params_row(spark.range(1).select(F.lit(trace / d).alias("moment_1"), F.lit(squares / d).alias("moment_2"))).select(*[_r(c, 4).alias(c) for c in ("moment_1", "moment_2", "gamma", "b_plus", "b_minus", "peak")])


_VALUES_SQL = "v AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) / 4000 AS x FROM customer)"


def _values(spark, sf_dir) -> DataFrame:
    """A whole column in place of a spectrum, most of it between the edges of a distribution, some of it beyond."""
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 4000).alias("x"))


@query(f"""WITH {_VALUES_SQL}, a AS (SELECT avg(x) FILTER (WHERE x > 0.25 AND x < 2.25) AS m1, avg(x * x) FILTER (WHERE x > 0.25 AND x < 2.25) AS m2, count(*) AS n FROM v),
b AS (SELECT m1, m2 / (m1 * m1) - 1 AS g, n FROM a)
SELECT round(g, 6) + 0.0 AS gamma, round(m1 * (1 + sqrt(g)) ** 2 + (n / g) ** (-2.0 / 3) * g ** (5.0 / 6) * (1 + sqrt(g)) ** (4.0 / 3), 6) + 0.0 AS lambda_c FROM b""")
def tracy_widom(spark, sf_dir):
    x = F.col("x")
    return rmt.tracy_widom_row(_values(spark, sf_dir), (x > 0.25) & (x < 2.25), "x").select(_r("gamma", 6).alias("gamma"), _r("lambda_c", 6).alias("lambda_c"))


_P = {"b_plus": 2.25, "b_minus": 0.25, "s": 1.0, "gamma": 0.25}
_CDF_SQL = """CASE WHEN x < 0.25 THEN 0.0 WHEN x > 0.25 AND x < 2.25 THEN (pi() * 0.25 + sqrt((2.25 - x) * (x - 0.25))
 - 1.25 * atan(((2.25 - x) / (x - 0.25) - 1) / (2 * sqrt((2.25 - x) / (x - 0.25)))) + 0.75 * atan((0.25 * (2.25 - x) / (x - 0.25) - 2.25) / (1.5 * sqrt((2.25 - x) / (x - 0.25))))) / (2 * pi() * 0.25) ELSE 1.0 END"""


def _mp_columns(df: DataFrame) -> DataFrame:
    p = {k: F.lit(v) for k, v in _P.items()}
    x = F.col("x")
    return df.select("id", rmt.mp_pdf(x, **p).alias("pdf"), rmt.mp_cdf(x, **p).alias("cdf"))


@query(f"WITH {_VALUES_SQL} SELECT id, round(CASE WHEN x > 0.25 AND x < 2.25 THEN sqrt((2.25 - x) * (x - 0.25)) / (2 * pi() * 0.25 * x) END, 6) + 0.0 AS pdf, round({_CDF_SQL}, 6) + 0.0 AS cdf FROM v")
def mp_pdf_cdf(spark, sf_dir):
    return _mp_columns(_values(spark, sf_dir)).select("id", _r("pdf", 6).alias("pdf"), _r("cdf", 6).alias("cdf"))


@query(f"""WITH {_VALUES_SQL}, f AS (SELECT {_CDF_SQL} AS f FROM v), o AS (SELECT f, row_number() OVER (ORDER BY f) AS i, (SELECT count(*) FROM f) AS n FROM f)
SELECT round(max(greatest(i / n - f, f - (i - 1) / n)), 6) + 0.0 AS ks FROM o""")
def ks_distance(spark, sf_dir):
    return rmt.ks_distance(spark, _mp_columns(_values(spark, sf_dir)), "cdf").select(_r("ks", 6).alias("ks"))


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 30 AS w, count(*) AS n FROM customer)
SELECT CAST(least(floor((c_acctbal - lo) / w), 29) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (any_value(n) * any_value(w)), 9) + 0.0 AS density FROM customer, b GROUP BY 1""")
def spectrum_histogram(spark, sf_dir):
    return rmt.histogram(_read(spark, sf_dir, "customer"), "c_acctbal", 30).select("bin", "n", _r("density", 9).alias("density"))


@query(f"""WITH {FX1}, c AS (SELECT count(DISTINCT cell_id) AS n, count(DISTINCT gene_id) AS m, count(*) AS nnz FROM expr)
SELECT nnz, n * m - nnz AS n_zero, round(least(1.0, floor((1 - 0.95) * n * m) / (n * m - nnz)), 7) + 0.0 AS chance FROM c""")
def flip_chance(spark, sf_dir):
    m = supplier_part(spark, sf_dir)
    n, g, nnz = m.cells.count(), m.expr.select("gene_id").distinct().count(), sparsity.binarise(m.expr).count()
    return spark.createDataFrame([(nnz, n * g - nnz, round(sparsity.chance_of_flip(0.95, n, g, nnz), 7))], "nnz long, n_zero long, chance double")


@query(f"WITH {FX1}, p AS (SELECT cell_id, gene_id FROM (SELECT DISTINCT cell_id FROM expr) CROSS JOIN (SELECT DISTINCT gene_id FROM expr)) SELECT *, 1.0::DOUBLE AS value FROM p WHERE {_uniform_sql('grid')} < 0.05")
def bernoulli_grid(spark, sf_dir):
    m = _stored(spark, supplier_part(spark, sf_dir))
    return perturb.bernoulli_grid(m.cells, m.genes, 0.05, SEED)


@query(f"""WITH {FX1}, p AS (SELECT cell_id, gene_id FROM (SELECT DISTINCT cell_id FROM expr) CROSS JOIN (SELECT DISTINCT gene_id FROM expr))
SELECT *, 1.0::DOUBLE AS value FROM p ANTI JOIN expr USING (cell_id, gene_id) WHERE {_uniform_sql('flip')} < 0.04""")
def perturb_zeros(spark, sf_dir):
    m = _stored(spark, supplier_part(spark, sf_dir))
    return perturb.hashed_flips(m.expr, m.cells, m.genes, 0.04, SEED)


@query(f"""WITH {FX1}, p AS (SELECT cell_id, gene_id FROM (SELECT DISTINCT cell_id FROM expr) CROSS JOIN (SELECT DISTINCT gene_id FROM expr)),
r AS (SELECT cell_id, gene_id, 1.0::DOUBLE AS value FROM p WHERE {_uniform_sql('grid')} < 0.05)
SELECT cell_id, gene_id, sum(value) AS value FROM (SELECT cell_id, gene_id, value FROM expr UNION ALL FROM r) GROUP BY 1, 2""")
def perturbed_counts(spark, sf_dir):
    m = _stored(spark, supplier_part(spark, sf_dir))
    return perturb.with_grid(m.expr, m.cells, m.genes, 0.05, SEED)


@query(f"""WITH {FX5}, d AS (SELECT p.rep, s.comp_idx, p.comp_idx AS j, abs(list_inner_product(s.v, p.v)) AS a FROM (SELECT * FROM vec WHERE rep = 0) s, (SELECT * FROM vec WHERE rep > 0) p)
SELECT rep, comp_idx, arg_max(j, (a, -j)) AS match, round(max(a), 6) + 0.0 AS score FROM d GROUP BY 1, 2""")
def best_match(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return robust.best_match_join(v.where("rep = 0"), v.where("rep > 0")).select("rep", "comp_idx", "match", _r("score", 6).alias("score"))


_SCORES = f"{FX5}, sc AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.comp_idx, max(abs(list_inner_product(a.v, b.v))) AS score FROM vec a JOIN vec b ON a.rep < b.rep GROUP BY 1, 2, 3)"


@query(f"WITH {_SCORES} SELECT rep_a, rep_b, comp_idx, round(score, 6) + 0.0 AS score FROM sc")
def pair_scores(spark, sf_dir):
    return robust.pair_scores_join(vectors(spark, sf_dir)).select("rep_a", "rep_b", "comp_idx", _r("score", 6).alias("score"))


@query(f"""WITH {_SCORES}, q AS (SELECT comp_idx, quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM sc GROUP BY 1)
SELECT comp_idx, round(median(score), 6) + 0.0 AS rob_score, median(score) > 0.3 AS is_robust FROM sc JOIN q USING (comp_idx)
WHERE score BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) GROUP BY 1""")
def robust_components(spark, sf_dir):
    return robust.robust_components(robust.pair_scores_join(vectors(spark, sf_dir)), 0.3).select("comp_idx", _r("rob_score", 6).alias("rob_score"), "is_robust")


@query(f"WITH {_SCORES} SELECT comp_idx, round(avg(score), 6) + 0.0 AS mean_score, round(stddev_pop(score), 6) + 0.0 AS sd_score FROM sc GROUP BY 1")
def robust_score_plot(spark, sf_dir):
    return robust.plot_data(robust.pair_scores_join(vectors(spark, sf_dir))).select("comp_idx", _r("mean_score", 6).alias("mean_score"), _r("sd_score", 6).alias("sd_score"))


def _documents_result(spark, sf_dir) -> significance.Result:
    m = qc.filter_cells_and_genes(document_word(spark, sf_dir), min_genes_per_cell=1, min_cells_per_gene=15, mito_percent=0)
    return significance.find_optimal_pc(spark, m, Config())


@query()
def mp_fit(spark, sf_dir):
    m = customer_kind(spark, sf_dir)
    return significance.find_optimal_pc(spark, m, Config()).summary(spark)


@query()
def find_optimal_pc(spark, sf_dir):
    return _documents_result(spark, sf_dir).summary(spark)


@query()
def pc_embedding(spark, sf_dir):
    return significance.pca(_documents_result(spark, sf_dir))


@query()
def fit_report(spark, sf_dir):
    return significance.fit_report(spark, significance.find_optimal_pc(spark, customer_kind(spark, sf_dir), Config()))


@query(f"""WITH {FX2}, {NORM}, {GRAM_GENE}, t AS (SELECT sum(g * g) / (SELECT n FROM k) AS total, sum(g) FILTER (WHERE i = j) AS trace FROM gr)
SELECT (SELECT m FROM k) AS n, round(total, 3) + 0.0 AS total_variance, round(trace, 4) + 0.0 AS total_eigenvalue FROM t""")
def explained_variance(spark, sf_dir):
    m = _stored(spark, customer_kind(spark, sf_dir))
    norm = normalize.normalize(m.expr, m.cells)
    pairs, _, _ = spectrum.eigen(spark, norm, m.genes.count(), 10_000, top=1)
    rows = spectrum.explained_variance(pairs, norm.n)
    return rows.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("variance"), 3).alias("total_variance"), _r(F.sum("eigenvalue"), 4).alias("total_eigenvalue"))


@query(f"""WITH {FX1}, {NORM}, r AS (SELECT cell_id, sum(value * value) AS q, sum(value) ** 2 - sum(value * value) AS t FROM x GROUP BY 1),
a AS (SELECT sum(q) AS q, sum(q * q) AS qq, sum(t) AS t, sum(t * t) AS tt, (SELECT m FROM k) AS m, (SELECT least(n, m) FROM k) AS d FROM r)
SELECT round(q / m / d, 6) + 0.0 AS moment_1, round((qq + (q * q - qq) / m + (t * t - tt) / (m * (m - 1))) / (m * m) / d, 6) + 0.0 AS moment_2 FROM a""")
def null_moments(spark, sf_dir):
    """The mean over all row permutations, in closed form."""
    m = _stored(spark, supplier_part(spark, sf_dir))
    m1, m2 = spectrum.null_moments(normalize.normalize(m.expr, m.cells), m.genes.count())
    return spark.range(1).select(_r(F.lit(m1), 6).alias("moment_1"), _r(F.lit(m2), 6).alias("moment_2"))


@query(f"""WITH {FX1}, {NORM}, p AS (SELECT x.cell_id, x.gene_id, x.value, ((gene_id * 7919) % 1009) / 1009.0 - 0.5 AS a, ((gene_id * 104729) % 1013) / 1013.0 - 0.5 AS b FROM x),
sums AS (SELECT cell_id, sum(value * a) AS ya, sum(value * b) AS yb FROM p GROUP BY 1)
SELECT gene_id, round(sum(value * ya) / (SELECT m FROM k), 5) + 0.0 AS ga, round(sum(value * yb) / (SELECT m FROM k), 5) + 0.0 AS gb FROM x JOIN sums ON x.cell_id = sums.cell_id GROUP BY 1""")
def gram_product(spark, sf_dir):
    """X'X / genes times two vectors over row blocks: what the iterative solver asks for, without a Gram matrix."""
    normal, v = _with_vectors(spark, supplier_part(spark, sf_dir))
    return blocks.gram_rows(spark, normal, v, ["ga", "gb"]).select("gene_id", _r("ga").alias("ga"), _r("gb").alias("gb"))


def _with_vectors(spark, m: CountMatrix):
    """Normalised row blocks, and two vectors over their genes that SQL can repeat."""
    import numpy as np

    m = _stored(spark, m)
    g = np.sort(m.genes.select("gene_id").toArrow()["gene_id"].to_numpy())
    return blocks.normalize_blocks(spark, blocks.build(spark, m.expr, m.cells, g)), np.stack([(g * 7919) % 1009 / 1009 - 0.5, (g * 104729) % 1013 / 1013 - 0.5], axis=1)


@query(f"""WITH {FX2}, {NORM}, p AS (SELECT cell_id, value, ((gene_id * 7919) % 1009) / 1009.0 - 0.5 AS a, ((gene_id * 104729) % 1013) / 1013.0 - 0.5 AS b FROM x)
SELECT cell_id, round(sum(value * a) / sqrt(4 * (SELECT m FROM k)), 6) + 0.0 AS first, round(sum(value * b) / sqrt((SELECT m FROM k)), 6) + 0.0 AS second FROM p GROUP BY 1""")
def project_cells(spark, sf_dir):
    """Vectors over genes projected to cells through row blocks, a row a cell and component, as signals are."""
    import numpy as np

    normal, v = _with_vectors(spark, customer_kind(spark, sf_dir))
    rows = blocks.project(spark, normal, {0: blocks.Units(np.array([4.0, 1.0]), v)})
    return rows.groupBy("cell_id").pivot("comp_idx", [0, 1]).agg(F.first("value")).select("cell_id", _r("0", 6).alias("first"), _r("1", 6).alias("second"))


@query()
def sparsity_search(spark, sf_dir):
    m = customer_kind(spark, sf_dir)
    ids = [r[0] for r in m.genes.orderBy("gene_id").select("gene_id").collect()]
    return spark.createDataFrame(sparsity.find_sparsity(spark, m.expr, m.cells, ids, Config())[1])
