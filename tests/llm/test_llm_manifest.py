"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orbitframe.llm import merkle_manifest, runtime

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """The root, and each leaf's siblings (before, after) by level."""
    paths = [[] for _ in nodes]
    level = 1
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            x = k // level
            low = x - x % 3
            path.append((nodes[low:x], nodes[x + 1 : low + 3]))
        nodes = [joined(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        level *= 3
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    groups = {k: sorted(v, key=lambda t: t[:3]) for k, v in groups.items()}
    trees = {k: tree([t[2] for t in groups[k]]) for k in keys}
    root, upper = tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, above in zip(keys, upper, strict=True):
        for (_, _, own, r), below in zip(groups[k], trees[k][1], strict=True):
            path = below + above
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            h = leaf(r, None if r.text is None else r.text.replace("\n", "")) if changed else own
            for before, after in path:
                h = joined(*before, h, *after)
            out.append((r.doc_id, own, trees[k][0], root, joined(*[s for b, a in path for s in b + a]), h, h == root))
    return out


def same(got, want):
    key = lambda t: tuple((x is not None, x) for x in t)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("broadcast", [runtime.BROADCAST_IDS, 0])
def test_repeated_and_missing_ids(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(runtime, "BROADCAST_IDS", broadcast)
    rng = random.Random(1)
    ids = [None, 0, 1, 5, 63, 64, -1, -64, -65, 70_000, 1 << 40, *range(1500)]
    rows = [(rng.choice(ids), rng.choice([None, "", "a", "b", "é", *"a" * 8]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", str(rng.random())])) for _ in range(2000)]
    rows += [(7, "a", "en", 1, "same")] * 800 + [(None, "a", None, None, None)] * 30
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "place", "n", "leaf", "node", "root", "path", "block", "word")})
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    got = merkle_manifest.query(spark, str(tmp_path)).collect()
    assert same(got, by_hand(df.collect()))


@pytest.mark.parametrize("n", [1, 4, 1458, 2188])
def test_sizes_about_the_slot_arrays(spark, tmp_path, n):
    rows = [(k, "only" if k % 2 or n < 3 else "other", "en", k, "some\ntext") for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert same(merkle_manifest.query(spark, str(tmp_path)).collect(), by_hand(df.collect()))


def test_ranks_are_places_of_sorted_ids(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-(1 << 45), 1 << 45), 500) + list(range(1000, 1400))
    rows = spark.createDataFrame([(i, "=s") for i in ids], "doc_id long, source_key string").withColumns({"leaf": F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), "tampered": F.lit(None).cast("binary")})
    got = {r.doc_id: r.place for r in merkle_manifest.ranked(runtime.cut(rows)).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_long_texts_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "en", 1, "é\n" * 400_000), (2, "s", "en", 1, "")], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert same(merkle_manifest.query(spark, str(tmp_path)).collect(), by_hand(df.collect()))
    assert merkle_manifest.manifest(df.limit(0)).collect() == []
