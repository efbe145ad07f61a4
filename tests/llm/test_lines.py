import random
import re

import pyspark.sql.functions as F
from conftest import ODD_TEXTS

from eigenforge.llm import line_dedup, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORDS.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_op5_base_counts(spark, make_docs):
    rng = random.Random(2)
    texts = [*ODD_TEXTS, "x " * 7, "x " * 8, "x " * 9, "a b c d e f g h " * 2 + "i j k", "\n".join(["l1 é", "", " ", "l1 é", "l2"] * 3), "w" * 200_000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "&", "Z"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id"), (1, "again")]
    got = quality.measure(make_docs(rows).withColumn("lines", F.lit(0)).withColumn("n_words", F.lit("x"))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in got), key=key) == sorted(((i, *brute_base(t)) for i, t in rows), key=key)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.verdicts(make_docs([])).count() == 0


def test_op5_rules(spark, make_docs):
    clean = "The first sentence of this text is plain prose, and so is all that comes after it.\nAnother line follows here, and it ends too."
    cases = [clean, clean + "\nHome | About | Contact | Help", "SHOUTING ALL THE TIME!! NOTHING ELSE IN HERE, REALLY, JUST LETTERS IN CAPITALS, ON AND ON AND ON. SO IT GOES, AGAIN.", "word&&& " * 12 + "and more### words*** here. so it goes on for a while."]
    cases += [clean + "\nWe use cookies. Read our Privacy Policy now.", "no marks at all " * 12]
    got = {r["doc_id"]: r for r in quality.measure(make_docs(list(enumerate(cases)))).collect()}
    assert [got[i]["kept"] for i in range(6)] == [True, True, False, False, True, False]
    assert got[0]["clean_text"] == clean and got[1]["clean_text"] == clean and got[4]["clean_text"] == clean


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def brute_lines(rows, min_chars, near_min):
    seen, out = [], []
    for i, text in sorted(rows):
        keep, exact, near = [], 0, 0
        for raw in text.split("\n"):
            line = raw.strip(" \t\r")
            if line:
                words = line.split(" ")
                if any(line == x for x, _ in seen):
                    exact += 1
                elif len(words) >= near_min and len(line) >= min_chars and any(len(y) >= near_min and len(x) >= min_chars and edit_at_most_one(words, y) for x, y in seen):
                    near += 1
                    seen.append((line, words))
                else:
                    keep.append(raw)
                    seen.append((line, words))
                    continue
            else:
                keep.append(raw)
        out.append((i, "\n".join(keep), exact, near))
    return out


def test_op4_against_brute_force(spark, make_docs):
    rng = random.Random(3)
    vocab = ["aa", "bb", "cc"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(4, 18))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(words))
                kind = rng.random()
                if kind < 0.4:
                    words[at] = rng.choice(vocab)
                elif kind < 0.7 and len(words) > 2:
                    del words[at]
                else:
                    words.insert(at, rng.choice(vocab))
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark, make_docs(rows).withColumn("place", F.lit(1)), min_chars=10, near_min=5).collect()
    assert sorted((r["doc_id"], r["text"], r["n_exact"], r["n_near"]) for r in got) == brute_lines(rows, 10, 5)


def test_op4_odd_rows(spark, make_docs):
    passage = "this passage of a dozen words or so is found in many documents here"
    rows = [(None, passage), (1, None), (2, ""), (3, passage + "\nown line of this very document"), (3, passage + "\nanother text with the same id here"), (4, "x\n" + passage), (4, "x\n" + passage), (5, "short\nshort"), (6, passage.replace("dozen", "score")), (7, (passage + "\n") * 500), (8, "\n \n\n"), (9, "z" * 30_000 + " " + "tail " * 3000)]
    got = line_dedup.dedup_lines(spark, make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_exact"], r["n_near"]))
    assert by[1] == [(None, 0, 0)] and by[8] == [("\n \n\n", 0, 0)] and by[9][0][1:] == (0, 0) and by[2] == [("", 0, 0)] and by[5] == [("short", 1, 0)]
    assert sum(passage in (t or "") for rows_ in by.values() for t, _, _ in rows_) == 1  # only the earliest of the two rows with id 3
    assert by[4] == [("x", 1, 0)] * 2 and by[6] == [("", 0, 1)] and by[None] == [("", 1, 0)] and by[7] == [("", 500, 0)]
    assert line_dedup.dedup_lines(spark, make_docs([])).count() == 0
