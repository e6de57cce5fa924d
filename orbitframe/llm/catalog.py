"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat_quotes, conversation_repair, decontaminate, merkle_manifest, ngram_jaccard, pii, quality_classifier, quality_rules, secrets, sentencepiece_lattice, token_files, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.query,
    "op2_sentencepiece": sentencepiece_lattice.query,
    "op3_quality_rules": quality_rules.query,
    "op4_pii": pii.query,
    "op5_chat_quotes": chat_quotes.query,
    "op6_decontaminate": decontaminate.query,
    "op7_token_files": token_files.query,
    "op8_toxicity": toxicity.query,
    "op9_secrets": secrets.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_byte_bpe": byte_bpe.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_conversation_repair": conversation_repair.query,
}


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"

def _more(paths: str, cost: str, letter: str) -> str:
    """SQL for a path, eight digits of cost and then letters, with one edit more."""
    return f"lpad(CAST(CAST(substr({paths}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({paths}, 9) || '{letter}'"


#: The step of a row over the best paths s0..s3 by state, as texts that compare by cost and then letters; insertions follow.
_STEP = f"""SELECT d.name, d.i + 1 AS i, {_more("s0", "4", "D")} AS s0,
    least({_more("s1", "4", "D")}, CASE WHEN fault < 2 AND initial = 's' THEN {_more("s0", "late", "K")} END) AS s1,
    least({_more("s2", "4", "D")}, CASE WHEN fault < 2 AND initial = 'u' THEN {_more("least(s0, s1, s3)", "late", "K")} END, CASE WHEN fault < 2 THEN {_more("least(s0, s1, s3)", "3 + late", "R")} END) AS s2,
    least({_more("s3", "4", "D")}, CASE WHEN fault < 2 AND initial = 'a' THEN {_more("s2", "late", "K")} END, CASE WHEN fault < 2 THEN {_more("s2", "3 + late", "R")} END) AS s3
  FROM dp d JOIN f ON f.name = d.name AND f.i = d.i + 1"""
_GIVES = "CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END"

SQL = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op6_decontaminate": r"""
WITH items AS (SELECT item_id, words, len(words) AS n, least(len(words), 5) AS width FROM (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark) WHERE len(words) > 0),
places AS (SELECT item_id, n, width, j, array_to_string(words[j + 1:j + width], ' ') AS s FROM (SELECT *, unnest(generate_series(0, n - width)) AS j FROM items)),
own AS (SELECT DISTINCT item_id, s FROM places),
weights AS (SELECT s, 1.0 / count(*) AS w FROM own GROUP BY s),
totals AS (SELECT item_id, sum(w) AS total FROM own JOIN weights USING (s) GROUP BY item_id),
docs AS (SELECT doc_id, words, len(words) AS size FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)),
cut AS (SELECT doc_id, width, size, spot, array_to_string(words[spot + 1:spot + width], ' ') AS s FROM (
  SELECT doc_id, words, size, width, unnest(generate_series(0, size - width)) AS spot FROM docs CROSS JOIN (SELECT DISTINCT width FROM items) WHERE size >= width)),
windows AS (SELECT DISTINCT c.doc_id, greatest(0, least(c.spot - p.j, c.size - p.n)) AS start, p.n FROM cut c JOIN (SELECT DISTINCT s, width, j, n FROM places) p ON p.s = c.s AND p.width = c.width),
held AS (SELECT DISTINCT w.doc_id, w.start, w.n, o.item_id, c.s FROM windows w JOIN cut c ON c.doc_id = w.doc_id AND c.spot >= w.start AND c.spot + c.width <= w.start + w.n
  JOIN places o ON o.s = c.s AND o.width = c.width AND o.n = w.n),
scored AS (SELECT doc_id, start, n, item_id, sum(w) / any_value(total) AS similarity FROM held JOIN weights USING (s) JOIN totals USING (item_id) GROUP BY doc_id, start, n, item_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(similarity, 9) DESC, start) AS r FROM scored WHERE similarity >= 0.8 - 1e-12)
SELECT doc_id, item_id, CAST(start AS INT) AS start_word, CAST(n AS INT) AS n_words, round(similarity, 6) AS similarity FROM best WHERE r = 1""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other, {_crc32("CAST(doc_id AS VARCHAR)")} AS crc FROM documents),
p AS (SELECT *, CASE WHEN crc % 2 = 0 THEN other ELSE leaf END AS start, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
nodes AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 3),
sib AS (SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.pos),
walk AS (SELECT rid, g, 0 AS lvl, pos, start AS h, '' AS proof FROM p
  UNION ALL SELECT w.rid, w.g, w.lvl + 1, w.pos // 3, sha256(s.before || w.h || s.after), w.proof || s.before || s.after FROM walk w JOIN sib s ON s.g = w.g AND s.lvl = w.lvl AND s.pos = w.pos),
own AS (SELECT rid, g, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM walk GROUP BY rid, g),
tops AS (SELECT g, arg_max(h, lvl) AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes GROUP BY g),
upper AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM tops
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3),
above AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
climb AS (SELECT o.rid, 0 AS lvl, t.pos, o.h, o.proof, t.subroot FROM own o JOIN tops t ON t.g = o.g
  UNION ALL SELECT c.rid, c.lvl + 1, c.pos // 3, sha256(a.before || c.h || a.after), c.proof || a.before || a.after, c.subroot FROM climb c JOIN above a ON a.lvl = c.lvl AND a.pos = c.pos),
done AS (SELECT rid, any_value(subroot) AS subroot, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM climb GROUP BY rid)
SELECT p.doc_id, p.leaf, e.subroot, r.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.root AS verified
FROM p JOIN done e ON e.rid = p.rid CROSS JOIN (SELECT arg_max(h, lvl) AS root FROM upper) r""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations),
damaged AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS name, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY name ORDER BY i) AS before, CASE WHEN fault = 1 THEN 3 ELSE 0 END AS late FROM (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY name, role, text ORDER BY i) > 1 THEN 3 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 1 END AS fault FROM n)),
dp AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '00000003I' AS s2, '00000006II' AS s3 FROM damaged
  UNION ALL SELECT name, i, s0, s1, s2, least(s3, {_more("s2", "3", "I")}) FROM (SELECT name, i, s0, s1, least(s2, {_more("least(s0, s1, s3)", "3", "I")}) AS s2, s3 FROM ({_STEP}))),
best AS (SELECT name, CAST(substr(p, 1, 8) AS BIGINT) AS cost, substr(p, 9) AS audit FROM (SELECT name, arg_max(least(s0, s3), i) AS p FROM dp GROUP BY name)),
w AS (SELECT name, audit, 0 AS k, CAST(1 AS BIGINT) AS i, 0 AS state, CAST(NULL AS VARCHAR) AS done FROM best
  UNION ALL SELECT name, audit, k + 1, CASE WHEN letter = 'I' THEN i ELSE i + 1 END,
    CASE WHEN letter = 'D' THEN state WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN letter = 'D' THEN done ELSE coalesce(done || chr(10), '') || CASE letter WHEN 'I' THEN {_GIVES} || ':' WHEN 'K' THEN role || ':' || text ELSE {_GIVES} || ':' || text END END
  FROM (SELECT w.*, substr(audit, k + 1, 1) AS letter, f.role, f.text, f.initial FROM w LEFT JOIN f ON f.name = w.name AND f.i = w.i WHERE k < len(audit))),
repaired AS (SELECT name, sha256(coalesce(arg_max_null(done, k), '')) AS h FROM w GROUP BY name),
counts AS (SELECT name, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY name)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS name FROM conversations) a LEFT JOIN counts USING (name) LEFT JOIN best USING (name) LEFT JOIN repaired USING (name)""",
}
