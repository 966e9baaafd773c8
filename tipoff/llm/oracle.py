"""SQL of the operators that SQL can express, for small scales: recursion over levels, rows and links."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The table of CRC-32 by its rule, and the CRC of an ASCII text.
_CRC_TABLE = "crctable AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split({text}, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_encoded(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, base: str, key: str) -> str:
    """nodes of each group's tree, level by level."""
    return f"""{name} AS (SELECT {key}, 0 AS level, place, digest, size FROM {base}
UNION ALL SELECT {key}, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (max(size) + 15) // 16 FROM {name} WHERE size > 1 GROUP BY {key}, level, place // 16)"""


OP12 = f"""WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(f'translate(text, {_LOWER})')} ELSE {_leaf('text')} END AS shown FROM documents, crctable),
placed AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaves),
{_tree('nodes', 'placed', 'source')},
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size, 0 AS tree FROM nodes WHERE size = 1),
{_tree('uppers', 'subroots', 'tree')},
runs AS (SELECT source, 0 AS part, level, place // 16 AS parent, string_agg(digest, '' ORDER BY place) AS whole, list(digest ORDER BY place) AS digests FROM nodes WHERE size > 1 GROUP BY source, level, place // 16),
upper_runs AS (SELECT level, place // 16 AS parent, list(digest ORDER BY place) AS digests FROM uppers WHERE size > 1 GROUP BY level, place // 16),
steps AS (SELECT p.doc_id, p.leaf, p.source, p.place, p.shown, r.level AS step, r.digests, CAST((p.place // CAST(pow(16, r.level) AS BIGINT)) % 16 AS INT) AS spot FROM placed p JOIN runs r ON r.source IS NOT DISTINCT FROM p.source AND r.parent = p.place // CAST(pow(16, r.level + 1) AS BIGINT)
  UNION ALL SELECT p.doc_id, p.leaf, p.source, p.place, p.shown, 100 + r.level, r.digests, CAST((s.place // CAST(pow(16, r.level) AS BIGINT)) % 16 AS INT) FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN upper_runs r ON r.parent = s.place // CAST(pow(16, r.level + 1) AS BIGINT)),
ordered AS (SELECT source, place, list({{'before': array_to_string(list_slice(digests, 1, spot), ''), 'after': array_to_string(list_slice(digests, spot + 2, len(digests)), '')}} ORDER BY step) AS path FROM steps GROUP BY source, place),
fold AS (SELECT p.source, p.place, 0 AS k, p.shown AS digest, coalesce(o.path, []) AS path FROM placed p LEFT JOIN ordered o ON o.source IS NOT DISTINCT FROM p.source AND o.place = p.place
  UNION ALL SELECT source, place, k + 1, sha256(path[k + 1].before || digest || path[k + 1].after), path FROM fold WHERE k < len(path))
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(array_to_string([x.before || x.after FOR x IN f.path], '')) AS proof_sha256, f.digest AS folded_root, f.digest = u.digest AS verified
FROM placed p JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.place = p.place AND f.k = len(f.path) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN uppers u ON u.size = 1"""


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(v: str, cost: str, edit: str, line: str = "") -> str:
    lines = f"list_concat([{line}], {v}.lines)" if line else f"{v}.lines"
    return f"CASE WHEN {v} IS NOT NULL THEN {{'cost': {v}.cost + {cost}, 'audit': '{edit}' || {v}.audit, 'lines': {lines}}} END"


_USER, _ASSISTANT = "'user:'", "'assistant:'"
_TURN = "role || ':' || text"
_STAYS = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"


def _row(delete: str, to: str, initial: str, own: str, keep_s: str = "") -> str:
    """The ways of one row from a state: delete; keep or change the role to the next legal one; a system turn at the start."""
    stays = [f"CASE WHEN first = '{initial}' THEN {_way(to, _STAYS, 'K', _TURN)} END", _way(to, f"1 + {_STAYS}", "R", f"'{own}:' || text")]
    if keep_s:
        stays.append(f"CASE WHEN first = 's' THEN {_way(keep_s, _STAYS, 'K', _TURN)} END")
    return _best(_way(delete, "2", "D"), *(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {w} END" for w in stays))


OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit FROM conversations, crctable),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hits WHERE hit <> 0),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, left(role, 1) AS first, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
faulty AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows),
seen AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS v0, {{'cost': 10, 'audit': 'II', 'lines': [{_USER}, {_ASSISTANT}]}} AS v1, {{'cost': 5, 'audit': 'I', 'lines': [{_ASSISTANT}]}} AS v2, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS v3 FROM seen
  UNION ALL SELECT conv_id, i - 1, {_best('b0', _way('c2', '5', 'I', _USER))}, {_best('b1', _way('c2', '5', 'I', _USER))}, c2, {_best('b3', _way('b2', '5', 'I', _USER))} FROM (SELECT *, {_best('b2', _way('b3', '5', 'I', _ASSISTANT))} AS c2 FROM (
    SELECT conv_id, i, {_row('v0', 'v2', 'u', 'user', 'v1')} AS b0, {_row('v1', 'v2', 'u', 'user')} AS b1, {_row('v2', 'v3', 'a', 'assistant')} AS b2, {_row('v3', 'v2', 'u', 'user')} AS b3 FROM walk JOIN faulty USING (conv_id, i)))),
done AS (SELECT conv_id, v0 FROM walk WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.cost, 0) AS BIGINT) AS cost, coalesce(v0.audit, '') AS audit, sha256(coalesce(array_to_string(v0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""

OP13 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least AS component_id FROM sets JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) ON a = doc_id"""

ORACLES = {"op11_conversation_repair": OP11, "op12_merkle_manifest": OP12, "op13_ngram_jaccard_join": OP13}
