"""Quotation links, FTRL weights, index vectors and token files against plain Python that shares no code with them but hashes."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import chat_quotes, quality_classifier, sentencepiece_lattice, token_files, toxicity


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120)


# --- 5

def levels(text):
    """(level, body) of the lines that count."""
    lines = []
    for line in re.split(r"\r?\n", text or ""):
        marks = re.match(r"(?:[ \t]*>)+", line)
        lines.append((marks[0].count(">"), line[marks.end() :].lstrip(" ")) if marks else (0, line))
    starts = lambda i: i + 1 < len(lines) and lines[i + 1][0] > 0 and lines[i][0] == 0 and re.match(r"(?i)\s*(?:on\b.*|.{1,80}) wrote:\s*$", lines[i][1])
    return [x for i, x in enumerate(lines) if not starts(i)]


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def brute_links(messages):
    """{turn: (parent, path of turns, quoted passages, links)} of one conversation's {turn: text}."""
    own, asked, passages = defaultdict(list), {}, {}
    for turn, text in sorted(messages.items()):
        lines, runs = levels(text), []
        for level, body in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        runs = [(level, " ".join(b)) for level, b in runs]
        for body in {plain(b) for b in [" ".join(b for k, b in lines if not k), *(b for k, b in runs + lines if not k)]}:
            own[body].append(turn)
        passages[turn] = sum(k > 0 for k, _ in runs)
        asked[turn] = {(k, plain(b)) for k, b in runs + lines if k and len(plain(b)) >= 2}
    out = {}
    for turn in sorted(messages):
        found = [(k, b, min(own[b])) for k, b in asked[turn] if own.get(b) and min(own[b]) < turn]
        weight = defaultdict(int)
        for k, b, origin in found:
            if k == 1:
                weight[origin] += len(b)
        parent = max(((w, o) for o, w in weight.items()), default=(0, None))[1]
        out[turn] = (parent, (*out[parent][1], turn) if parent is not None else (turn,), passages[turn], len(found))
    return out


def test_quotations_against_brute_force(spark):
    rng = random.Random(11)
    words = ["sort", "Table", "join,", "is it", "stable?", "No!", "yes", "über", "a"]
    conversations = {}
    for conv in range(40):
        turns = sorted(rng.sample([-(1 << 40), -7, -1, *range(12), 10**11, 1 << 62], rng.randint(1, 12)))
        messages = {}
        for turn in turns:
            lines = []
            for _ in range(rng.randint(0, 5)):
                if messages and rng.random() < 0.5:
                    source = rng.choice([x for t in messages.values() for x in t.split("\n")] + ["unknown words"])
                    if rng.random() < 0.2:
                        lines.append("On Monday Ann wrote:")
                    lines.append(rng.choice(["> ", ">", "> > ", ">>"]) + rng.choice([str.upper, str.lower, str])(source))
                else:
                    lines.append(" ".join(rng.choices(words, k=rng.randint(1, 4))))
            messages[turn] = "\n".join(lines)
        conversations[conv] = messages
    rows = [(c, t, "user", x) for c, m in conversations.items() for t, x in m.items()]
    got = chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {(c, t): v for c, m in conversations.items() for t, v in brute_links(m).items()}
    assert {(r.conv_id, r.turn): (r.parent_turn, r.depth, r.n_quoted, r.n_linked) for r in got} == {k: (p, len(path) - 1, q, n) for k, (p, path, q, n) in want.items()}
    assert sum(v[0] is not None for v in want.values()) > 50 and max(len(v[1]) for v in want.values()) > 3
    order = sorted(got, key=lambda r: (r.conv_id, r.thread))
    assert [(r.conv_id, r.turn) for r in order] == sorted(want, key=lambda k: (k[0], want[k][1]))


# --- 7

def test_token_files_are_laid_out_for_selective_reads(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_GROUP", 64 << 10)
    monkeypatch.setattr(token_files, "PAGE", 8 << 10)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000), True).coalesce(1)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path)
    spread, groups = [], 0
    for file in sorted(tmp_path.glob("tokens/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(ids.encodings) and ids.compression == "ZSTD"
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            spread.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
            groups += 1
    # each id is in one row group, so a read of one document skips the others by their statistics
    assert groups > 1 and all(a[1] < b[0] for a, b in zip(sorted(spread), sorted(spread)[1:], strict=False))
    some = docs.agg(F.max("doc_id")).head()[0]
    one = token_files.read_token_files(spark, path).filter(F.col("doc_id") == some)
    plan = one.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(doc_id,{some})" in plan and "ids" not in plan.split("ReadSchema:")[1]
    assert one.count() == 1 and len(one.head().ids) == one.head().n_tokens


# --- 8

def brute_features(text, known):
    """Distinct features of a text; a feature's number is what the operator gives for the shortest text that has it."""
    w = [x.decode().lower() if x.isascii() else x.decode("utf-8", "surrogateescape") for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
    wanted = {x: 0 for x in w} | {f"{a} {b}": 2 for a, b in zip(w, w[1:], strict=False)} | {f"{a} x {b}": 5 for a, b in zip(w, w[2:], strict=False)}
    fresh = [x for x in wanted if x not in known]
    for first, last, row, feature in toxicity.feature_ids(pa.array(fresh, pa.string())):
        for i in range(last - first):
            known[fresh[first + i]] = feature[row == i].tolist()[wanted[fresh[first + i]]]
    return {known[x] for x in wanted}


def test_ftrl_against_plain_python(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    marked = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect()}
    keep = docs.filter(~toxicity.in_hold_out(F.col("doc_id"), toxicity.HOLD_OUT)).select("doc_id", "text", F.xxhash64("doc_id").alias("turn")).collect()
    known: dict[str, int] = {}
    rows = [([0, *sorted(f + 1 for f in brute_features(r.text, known))], marked[r.doc_id]) for r in sorted(keep, key=lambda r: r.turn) if r.doc_id in marked]
    assert len(rows) > 20 and 0 < sum(y for _, y in rows) < len(rows)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, y in rows:
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()))))) - y
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    for i in set(z) | set(model):
        assert abs(weight(i) - model.get(i, 0.0)) < 1e-6
    assert any(i and w for i, w in model.items())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        total = model.get(0, 0.0) + sum(model.get(f + 1, 0.0) for f in brute_features(r.text, known))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))) < 1e-9


# --- 10

def test_index_vectors_against_plain_python(docs):
    place, sign = quality_classifier.index_vectors()
    known: dict[bytes, int] = {}

    def tokens(text):
        out = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
        for t in out:
            if t not in known:
                known[t] = next(quality_classifier.token_buckets(pa.array([t.decode()])))[3].tolist()[0]
        return [known[t] for t in out]

    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    total = np.zeros((1 << quality_classifier.WORD_BITS, quality_classifier.DIMENSIONS))
    for at in rows.values():
        for i, a in enumerate(at):
            for b in at[max(0, i - 2) : i] + at[i + 1 : i + 3]:
                for p, s in zip(place[b], sign[b], strict=True):
                    total[a, p] += s
    size = np.sqrt((total**2).sum(1))
    want = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], 0)
    got = quality_classifier.word_vectors(docs)
    assert np.abs(got - want).max() < 1e-5
    rng = np.random.default_rng(2)
    d, h = quality_classifier.DIMENSIONS, quality_classifier.HIDDEN
    net = quality_classifier.Network(rng.normal(size=d), rng.uniform(0.5, 2, d), rng.normal(size=(d, h)), rng.normal(size=h), rng.normal(size=h), 0.3, 1.7)
    for r in quality_classifier.score(docs, got, net).collect():
        at = rows[r.doc_id]
        x = [sum(float(want[t, k]) for t in at) / len(at) if at else 0.0 for k in range(d)]
        x = [(v - c) / s for v, c, s in zip(x, net.centre, net.scale, strict=True)]
        hidden = [math.tanh(sum(v * net.w1[i, j] for i, v in enumerate(x)) + net.b1[j]) for j in range(h)]
        assert abs(r.score - 1 / (1 + math.exp(-(sum(v * w for v, w in zip(hidden, net.w2, strict=True)) + net.b2) / 1.7))) < 1e-4


# --- 2

def test_viterbi_of_whole_texts_against_dynamic_program(spark, docs):
    pieces = sentencepiece_lattice.Pieces.load(sentencepiece_lattice.default_model())
    table = {p: (i, s) for i, (p, s, ok) in enumerate(zip(pieces.pieces, pieces.scores, pieces.normal, strict=True)) if ok}
    odd = [(-1, None), (-2, ""), (-3, "q漢z 😀😀"), (-4, "e" * 1000 + " end"), (-5, "  two  spaces ")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).filter("text is null or length(text) < 6000")
    longest, unknown, want = pieces.longest, pieces.unknown_score, {}
    for r in rows.collect():
        text = (" " + r.text).replace(" ", "▁") if r.text else ""
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                found = table.get(text[start:end], (None, unknown) if end - start == 1 else None)
                if found:
                    best[end] = max(best[end], best[start] + found[1])
        want[r.doc_id] = text, best[-1]
    byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
    for small in (False, True):
        got = {r.doc_id: r for r in sentencepiece_lattice.encode(rows, paths=True, **({"dictionary": 50} if small else {})).collect()}
        assert got.keys() == want.keys()
        for k, (text, total) in want.items():
            assert abs(got[k].path_score - total) < 1e-6 * max(1, abs(total))
            # the path spells the text
            assert sentencepiece_lattice.decoded(np.array(got[k].path, dtype=np.int32), pieces.pieces, byte_of) == text.replace("▁", " ")[1:]
    digests = {r.doc_id: r for r in sentencepiece_lattice.round_trip(rows, paths=True).collect()}
    for k, r in digests.items():
        assert (r.n_path_ids, r.path_crc32, r.n_ids) == (len(got[k].path), zlib.crc32(np.array(got[k].path, "<u4").tobytes()), len(got[k].ids))
