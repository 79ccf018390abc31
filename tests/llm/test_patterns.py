"""Periodic runs and filter interactions against the definitions, worked out by hand."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

from lodestone.llm import lattice, periodic, queries

SF = "/root/testdata/sf0.001"


def slow_runs(words: list, min_exp: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """Every maximal stretch of each period, kept where that period is its smallest."""
    n, out = len(words), set()
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, min_exp * q) and not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                out.add((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def slow_row(text: str | None) -> tuple:
    words = (text or "").encode().split()
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return len(words), runs, best, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def random_text(rng: random.Random) -> str:
    """Words of a small alphabet with planted repetitions, some inside others, some broken by one word."""
    words: list[str] = []
    for _ in range(rng.randrange(1, 7)):
        unit = [rng.choice("abcé") for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(2, 6) + [rng.choice("xy")]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(3, 80)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
    return "".join(w + rng.choice([" ", "\n", "\t\v", "  "]) for w in words)


ODD = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 4 + "a", "x " + "  " * 6, "a\x1cb " * 7, "a " * 3000, ("b " * 50 + "c ") * 40, "a b c " * 100 + "a b d " * 100]


def as_rows(found) -> list[tuple]:
    return [(r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["best"] and (r["best"]["start"], r["best"]["length"], r["best"]["period"]), r["collapsed"]) for r in found.collect()]


def key(row: tuple) -> str:
    return repr(row)


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 17), (40, 3), (0, 1000)])
def test_runs_equal_the_definition(spark, limits):
    rng = random.Random(7)
    texts = [*ODD, *(random_text(rng) for _ in range(150)), *ODD[:4]]
    docs = spark.createDataFrame([(i % 9 if i % 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, Runs int").repartition(3)
    docs = docs.withColumnRenamed("Runs", "n_runs")
    found = periodic.scan(docs, long_bytes=limits[0], lags=limits[1])
    assert found.columns == ["doc_id", "text", "n_runs", "n_words", "runs", "best", "collapsed"]
    assert sorted(map(key, as_rows(found))) == sorted(key(slow_row(t)) for t in texts)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 9, "old", "kept", 5)], "doc_id long, text string, best string, _rid string, rid int")
    for limit in (0, 1 << 20):
        row = periodic.scan(docs, long_bytes=limit).first()
        assert (row["_rid"], row["rid"], row["best"]["length"], row["collapsed"]) == ("kept", 5, 9, "a")
        assert periodic.scan(docs.limit(0), long_bytes=limit).count() == 0


def test_exact_ties_of_exponents():
    """61 / 15 and 122 / 30 are equal; a ratio that floating point rounds alike must not win by its place."""
    import numpy as np

    assert periodic.best_run(np.array([9, 0]), np.array([122, 61]), np.array([30, 15])) == 1
    big = 3_000_000_019
    assert periodic.best_run(np.array([0, 5]), np.array([4 * big, 4 * big + 1]), np.array([big, big])) == 1


def test_query_of_runs_equals_the_definition(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    expected = {}
    for d in docs:
        words = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        _, runs, best, left = slow_row(b" ".join(words).decode())
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = best and 1000 * best[1] // best[2]
        expected[d["doc_id"]] = (len(runs), *(best or (None,) * 3), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
    found = queries.QUERIES["op13_periodic_runs"](spark, SF)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected
    assert sum(x[0] > 0 for x in expected.values()) > 5


def slow_audit(docs: list[tuple], labels: dict) -> dict:
    """Every order applied to every document, one after another."""
    first: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    masks = []
    for i, t, lang in docs:
        t = t or ""
        words = t.encode().split()
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t), "D": any(x in t for x in "#$%&*|"), "E": i is not None and first[t] < i}
        masks.append((lang or "", {f for f, x in bad.items() if x}, *labels.get(i, (False, False))))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in m[1] for m in own) - len(removed), sum(m[1] == {f} for m in own), sum(m[2] for m in removed), sum(m[3] for m in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(3)
    texts = ["", None, "one two", "A B C", "same " * 120, " ".join(map(str, range(130))), " ".join(map(str, range(130))) + " #", "ÄÖ Ü", "WORD " * 101, "a\x1cb | c"]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    labels = [(i % 30, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(None, 1, 1)]
    good = {i: (any(q == 1 for j, q, _ in labels if j == i), any(x == 1 for j, _, x in labels if j == i)) for i in range(30)}
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, part string")
    found = lattice.interactions(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == slow_audit(docs, good)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lattice.interactions(docs.limit(0), labels).count() == 0
    rows = lattice.interactions(docs, labels).collect()
    assert len(rows) == 600 and {r["good_lost"] for r in rows} == {0}


def test_lattice_has_80_edges_and_600_steps():
    assert len(lattice.edges("ABCDE")) == 80 and len(lattice.paths("ABCDE")) == 600
