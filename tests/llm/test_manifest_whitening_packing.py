"""The manifest, whitening and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import manifest, packing, whitening
from docquarry.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, path int, tree int, length int"
CLASH = ("clash", 7, 8, 9)


def _rows(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rnd.choice(["al", "bé", "the", "of", "x7", "ing"]) for _ in range(rnd.choice([1, 4, 40]))) for _ in range(rnd.choice([1, 2, 3])))
        out.append((i, text, rnd.choice(["en", None]), rnd.choice(["a", "a", "a", "b", "é", None]), len(text), *CLASH))
    out += [(n, None, "en", "a", None, *CLASH), (n + 1, "", None, "b", 0, *CLASH), (None, "lost\nwords", None, None, 3, *CLASH), (None, "lost", "x", "a", 3, *CLASH), (5, out[5][1], out[5][2], out[5][3], out[5][4], *CLASH),
            (7, "other\ntext", "en", out[7][3], 4, *CLASH), (n + 2, "word " * 20_000 + "\nend", "en", "a", 9, *CLASH), (n + 3, "alone", "en", "only", 5, *CLASH)]
    return out


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text, columns=None):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return _h(*said)


def _tree(leaves):
    """Levels of a tree from its leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def _way(levels, k):
    for level in levels[:-1]:
        run = level[k // 3 * 3 : k // 3 * 3 + 3]
        yield run[: k % 3], run[k % 3 + 1 :]
        k //= 3


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        by[source].append((doc_id is not None, doc_id or 0, _leaf(doc_id, source, lang, n_chars, text), _leaf(doc_id, source, lang, n_chars, changed), doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = _tree([trees[s][-1][0] for s in order])
    for t, s in enumerate(order):
        for k, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            now, siblings = x[3], []
            for left, right in [*_way(trees[s], k), *_way(top, t)]:
                siblings += left + right
                now = _h(*left, now, *right)
            yield x[4], x[2], trees[s][-1][0], top[-1][0], _h(*siblings), now, now == top[-1][0]


def _checked(docs, **params):
    out = manifest.check_copy(docs, {"text": manifest.tampered(F.col("text"), F.col("doc_id"))}, columns=("doc_id", "source", "lang", "n_chars", "text"), **params)
    return out.withColumn("proof_sha256", manifest.proof_digest(F.col("path")))


@pytest.mark.parametrize(("n", "stride"), [(0, 3), (1, 3), (70, 1), (300, 3), (300, 4)])
def test_manifest(spark, n, stride):
    rows = [r for r in _rows(n) if n > 7 or r[0] not in (5, 7)] if n > 7 else [(3, "a\nb", None, None, 3, *CLASH)][:n]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in _checked(docs, stride=stride).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == Counter(_manifest(rows))


def test_manifest_equals_sql(spark, tmp_path):
    rows = _rows(120, 9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLE_SQL["op11_interval_manifest"])
    got = QUERIES["op11_interval_manifest"](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_any_change_is_seen(spark):
    """A copy changed in any one column fails, a plain copy holds."""
    docs = spark.createDataFrame(_rows(40), SCHEMA)
    assert _all_hold(manifest.check_copy(docs, {}))
    for c, to in (("text", F.concat_ws("", "text", F.lit("x"))), ("source", F.lit("zz")), ("n_chars", F.coalesce("n_chars", F.lit(0)) + 1), ("lang", F.when(F.col("lang").isNull(), "-"))):
        assert not manifest.check_copy(docs, {c: to}).filter("verified").count()


def _all_hold(out):
    return out.count() == out.filter("verified").count() > 0


def test_nodes_carry_the_intervals_that_they_cover(spark):
    leaves = spark.range(100).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    trees = manifest.Trees(leaves, leaves.groupBy("tree").agg(F.count("*").alias("leaves")))
    levels = _tree([_h(str(i)) for i in range(100)])
    seen = set()
    for groups in trees.buckets:
        for r in groups.collect():
            assert (r.lo, r.hi) == (r.nodes[-1].lo, r.nodes[-1].hi)
            for x in r.nodes:
                assert x.hi == min(x.lo + 3**x.level, 100) and x.digest == levels[x.level][x.lo // 3**x.level]
                seen.add((x.level, x.lo))
    assert seen == {(k, i * 3**k) for k, level in enumerate(levels) for i in range(len(level))}


def _whitened(vectors, k=4):
    """Plain whitening of whole numbers."""
    fit = np.unique(vectors, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, s, e, (vectors - s / n) @ v[:, :k] / np.sqrt(e[:k])


@pytest.mark.parametrize(("n", "d", "seed"), [(400, 64, 1), (50, 5, 2), (300, 40, 3), (30, 64, 4)])
def test_whitening(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(0.4, 0.1, d) - 0.05
    if seed == 3:  # a close pair of eigenvalues
        x[:, :4] *= [1, 1.02, 1.02, 1]
    vectors = [*x.tolist(), *([x[0].tolist()] * n), None, [None] + [0.0] * (d - 1), [float("nan")] * d, [0.0] * (d - 1) + [float("inf")], [-0.0] * d]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x int, i int").repartition(4)
    got = whitening.whiten(table).collect()
    used = [i for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all()]
    whole = np.floor(256 * np.array([vectors[i] for i in used])).astype(np.int64)
    m, s, e, want = _whitened(whole)
    assert len(got) == len(used) * 4 and {r.n for r in got} == {m}
    at = {(r.vec_id, r.component): r for r in got}
    mine = np.array([[at[i, c].whitened for c in (1, 2, 3, 4)] for i in used])
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-7
    for c in range(4):
        assert abs(got[0].identity_error) < 1e-10 and abs(at[used[0], c + 1].explained - e[c] / e.sum()) < 1e-10
    for i, row in zip(used, whole, strict=True):
        assert at[i, 1].deviation == sum((m * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).count() == 0  # one distinct vector
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (1, [1.0, 2.0]), (4, [9.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.n, round(abs(r.whitened), 12), round(r.explained, 12)) for r in two) == [("1", 1, 2, 1.0, 1.0)] * 2 + [("None", 1, 2, 1.0, 1.0)]
    far = whitening.whiten(spark.createDataFrame([(i, [v, 0.0]) for i, v in enumerate([1e13, -1e13, 3.0])], "vec_id long, embedding array<double>"), 1).collect()
    assert {r.deviation for r in far if r.vec_id < 2} == {None}  # beyond a long


def test_leading_certifies_hard_spectra():
    """Clusters, ties and flat spectra end, by growth of the block if need be."""
    rng = np.random.default_rng(0)
    d = 60
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for values in (np.ones(d), np.r_[np.full(30, 2.0), np.ones(30)], np.linspace(1, 1 + 1e-9, d), np.r_[5, 4, np.zeros(58)], 1 + np.arange(d) * 1e-6, np.geomspace(1, 1e-12, d)):
        v = (basis * values) @ basis.T
        e, q = whitening.leading(lambda x, v=v: v @ x, d, 4)
        assert np.allclose(e, np.sort(values)[::-1][:4], rtol=1e-12)
        assert np.abs(v @ q - q * e).max() < 1e-12 * values.max() and np.abs(q.T @ q - np.eye(4)).max() < 1e-12


def _items(counts):
    return [n for n, c in counts.items() for _ in range(c)]


def _placed(counts, capacity):
    """The plan's items by sequence; checks that each sequence is gapless and each item placed once."""
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, capacity):
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            held[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items() if c}
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def _fewest(items, capacity):
    """The least number of bins, by search over all packings."""
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def search(i, bins):
        if i == len(items):
            return len(bins)
        best = len(items)
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and (k == 0 or bins[k] != bins[k - 1]):
                best = min(best, search(i + 1, tuple(sorted((*bins[:k], bins[k] + items[i], *bins[k + 1 :])))))
        return min(best, search(i + 1, tuple(sorted((*bins, items[i])))))

    return search(0, ())


def test_plan_against_search():
    rnd = random.Random(4)
    over = 0
    for _ in range(150):
        counts = Counter(rnd.choice([rnd.randint(1, 20), rnd.randint(7, 12)]) for _ in range(rnd.randint(1, 8)))
        over += len(_placed(counts, 20)) - _fewest(_items(counts), 20)
    assert over <= 3
    for _ in range(100):  # large items alone: the matching is the best there is
        counts = Counter(rnd.randint(7, 20) for _ in range(rnd.randint(1, 9)))
        assert len(_placed(counts, 20)) == _fewest(_items(counts), 20)


def test_plan_of_many():
    rnd = random.Random(5)
    for draw in (lambda: rnd.randint(1, 2048), lambda: rnd.choice([3, 5, 700]), lambda: 1, lambda: min(2048, int(rnd.lognormvariate(6, 1)) + 1), lambda: 683, lambda: 682):
        counts = Counter(draw() for _ in range(5000))
        held = _placed(counts, 2048)
        large = sum(c for n, c in counts.items() if 3 * n > 2048)
        bound = max(-(-sum(n * c for n, c in counts.items()) // 2048), -(-large // 2))
        assert len(held) <= 1.02 * bound + 1 or len({tuple(s) for s in held.values()}) and large


def test_packing(spark):
    rows = _rows(60) + [(900, "word " * 7000, "en", "a", 1, *CLASH), (901, "".join(f"{i} " for i in range(2047)).strip(), "en", "a", 1, *CLASH)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    library = Tokenizer.from_file(TOKENIZER)
    places, ids = packing.pack_documents(docs, TOKENIZER)
    got = places.collect()
    want = Counter()
    for r in rows:
        own = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        short = (len(own) - 1) % 2048 + 1
        cuts = [0, *range(short, len(own) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r[0], k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    total = sum(r.length for r in got)
    assert len(held) == -(-total // 2048)
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.sequences(places, ids).collect()}
    for s, parts in held.items():
        at = 0
        for offset, length, crc in sorted(parts):
            assert offset == at and zlib.crc32(joined[s][at : at + length].astype("<u4")) == crc
            at += length
        assert at == len(joined[s]) <= 2048
    nothing = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(nothing, TOKENIZER)[0].count() == 0


def test_packing_of_one_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 900)).otherwise(F.lit("short text")).alias("text"))
    got = packing.pack_documents(docs, TOKENIZER)[0].collect()
    assert len({r.sequence_id for r in got}) == max(500, -(-sum(r.length for r in got) // 2048))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 3000
