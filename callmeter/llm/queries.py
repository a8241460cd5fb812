"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, fim, fingerprints, jaccard, langid, lmscore, packing, pii, repair, secrets, toxicity, urls, vectors

QUERIES = {
    "op1_toxicity_nnpu": toxicity.op1_toxicity_nnpu,
    "op2_one_permutation_minhash": fingerprints.op2_one_permutation_minhash,
    "op3_jaccard_partition": jaccard.op3_jaccard_partition,
    "op4_cross_entropy_difference": lmscore.op4_cross_entropy_difference,
    "op5_semi_markov_pii": pii.op5_semi_markov_pii,
    "op6_cover_tree": vectors.op6_cover_tree,
    "op7_language_bitmask": langid.op7_language_bitmask,
    "op8_blob_ledger": secrets.op8_blob_ledger,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_bpe_chunk_reuse": bpe.op10_bpe_chunk_reuse,
    "op11_exception_index_fim": fim.op11_exception_index_fim,
    "op12_prefix_doubling_repair": repair.op12_prefix_doubling_repair,
    "op13_association_rules": urls.op13_association_rules,
}

_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""


def _found(rule: secrets.Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(string_split_regex(t, '{p}'), lambda x: length(x))[1:i]) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x))[1:i - 1]), 0) AS BIGINT), 'rank': {rank},
      'size': length(regexp_extract_all(t, '{p}')[i]), 'kind': '{rule.kind}', 'ok': length(regexp_extract_all(t, '{p}', {rule.group})[i]) >= {rule.least}}}), lambda s: s.ok)"""


_RULES = (*secrets.BASE_RULES, *secrets.MORE_RULES)
_JOINED = "array_to_string(list_transform({0}, lambda z: z.kind || ':' || z.start || ':' || (z.start + z.size)), ',')"

_WS = r"\x20\x09-\x0D"


def _struct(cost: str, edit: str, line: str | None, then: str) -> str:
    """The cheapest rest of a conversation behind one more edit: cost, audit, messages."""
    body = f"list_prepend({line}, {then}.b)" if line else f"{then}.b"
    return f"{{'c': {then}.c + {cost}, 'a': '{edit}' || {then}.a, 'b': {body}}}"


def _edits(keeps: dict[str, int], role: str, to: int, here: int) -> str:
    """The least of what a row can become in a state. Lists of states count from 1: start, after s, after u, after a."""
    keep = " ".join(f"WHEN fault < 2 AND initial = '{k}' THEN {_struct('late', 'K', "role || ':' || text", f's[{v}]')}" for k, v in keeps.items())
    rerole = _struct("2 + late", "R", f"'{role}:' || text", f"s[{to}]")
    return f"list_min(list_filter([{_struct('3', 'D', None, f's[{here}]')}, CASE WHEN fault < 2 THEN {rerole} END, CASE {keep} END], lambda x: x IS NOT NULL))"


def _insert(base: str, role: str, then: str) -> str:
    return f"list_min([{base}, {_struct('2', 'I', f"'{role}:'", then)}])"


SQL: dict[str, str] = {
    "op3_jaccard_partition": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_AZ}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
{_REACH}
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id, (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links FROM s LEFT JOIN least ON s.doc_id = least.a""",
    "op6_cover_tree": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT r, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(vec_id) AS m FROM reach JOIN v ON b = r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = r) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(coalesce(m, vec_id) = vec_id, false) AS kept FROM v LEFT JOIN least ON r = least.a""",
    "op8_blob_ledger": f"""WITH f AS (SELECT doc_id, list_sort(list_concat({', '.join(_found(r, i) for i, r in enumerate(_RULES))})) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, {', '.join(f"CAST(len(list_filter(s, lambda x: x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE_RULES)},
  sha256({_JOINED.format(f"list_filter(s, lambda x: x.rank < {len(secrets.BASE_RULES)})")}) AS base_sha256, {_JOINED.format('s')} AS spans FROM f""",
    "op11_exception_index_fim": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM u),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_prefix_doubling_repair": f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 20 AS f FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE f <> 0),
n AS (SELECT *, left(role, 1) AS initial, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS was, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS times FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
e AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_WS}]') THEN 3 WHEN times > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][{_WS}]*$') THEN 1 ELSE 0 END AS fault FROM n),
r AS (SELECT conv_id, max(i) + 1 AS i, [{{'c': 0, 'a': '', 'b': CAST([] AS VARCHAR[])}}, {{'c': 4, 'a': 'II', 'b': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 'b': ['assistant:']}}, {{'c': 0, 'a': '', 'b': CAST([] AS VARCHAR[])}}] AS s FROM e GROUP BY conv_id
UNION ALL SELECT conv_id, i, [{_insert('b0', 'user', 'm2')}, {_insert('b1', 'user', 'm2')}, m2, m3] FROM (SELECT *, {_insert('b2', 'assistant', 'b3')} AS m2, {_insert('b3', 'user', 'b2')} AS m3 FROM (
  SELECT conv_id, i, {_edits({'s': 2, 'u': 3}, 'user', 3, 1)} AS b0, {_edits({'u': 3}, 'user', 3, 2)} AS b1, {_edits({'a': 4}, 'assistant', 4, 3)} AS b2, {_edits({'u': 3}, 'user', 3, 4)} AS b3
  FROM (SELECT e.*, s, CAST(fault = 1 AS INTEGER) AS late FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i - 1)))),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s[1].c, 0) AS BIGINT) AS cost, coalesce(s[1].a, '') AS audit, sha256(coalesce(array_to_string(s[1].b, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = 1""",
}
