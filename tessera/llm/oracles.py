"""DuckDB twins of the operators that SQL can express; each is written from the contract, not from the Spark code."""

from __future__ import annotations

_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The table of the CRC-32 polynomial; a checksum is worked out bytewise from it.
CRC_TABLE = "bits AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"


def crc(decimal: str) -> str:
    """The checksum of a column of digits; reads t of CRC_TABLE."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length({decimal})), lambda p: CAST(ascii(substr({decimal}, CAST(p + 1 AS BIGINT), 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_MARKS = r"len(regexp_extract_all({}, '<\\*/?s>|\[\\*(?:/?(?:SYSTEM|INST|TURN)|ROLE)\]'))"
_TURNS = "ORDER BY turn NULLS FIRST, role, text"

#: What the template adds to each role's text: its strings, and a backslash for each control string.
CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
m AS (SELECT *, length(text) + {_MARKS.format("text")} + CASE role WHEN 'assistant' THEN length('<s></s>') WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'system' THEN length('[SYSTEM]  [/SYSTEM]') ELSE length('[ROLE][TURN]  [/TURN]') + length(role) + {_MARKS.format("role")} END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_TURNS})) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' {_TURNS}), '')) AS loss_sha256, CAST(sum(shown) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id
"""

#: Every node meets each of its ancestors along the rows of its least member.
TRIE_SQL = rf"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, count(*) AS n FROM own GROUP BY 1),
conv AS (SELECT s.conv_id, s.h, least(s.h, coalesce(b.n, 0)) AS k FROM (SELECT conv_id, {crc("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM size, bits) s LEFT JOIN size b ON b.conv_id = s.conv_id - s.conv_id % 20),
seq AS (SELECT conv_id, 0 AS depth, '' AS role, '' AS text FROM conv UNION ALL SELECT c.conv_id, r, role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND r <= k UNION ALL SELECT c.conv_id, k + r - h, role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND r > h),
named AS (SELECT conv_id, depth, text, md5(string_agg(CASE WHEN depth > 0 THEN md5(role) || md5(text) END, '') OVER w) AS prefix, lead(depth) OVER w IS NULL AS ends FROM seq WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
path AS (SELECT *, coalesce(prefix, '') AS node, lag(coalesce(prefix, '')) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM named),
node AS (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS own, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM path GROUP BY 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY 1),
below AS (SELECT a.node, sum(n.own) AS saved, count_if(k.node IS NULL) AS leaves FROM node n JOIN path a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM node n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN node p ON p.node = n.parent
"""


def _encoded(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_encoded(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(start: str, name: str, levels: int) -> list[str]:
    """Nodes (g, pos, h, n) and runs (g, run, hs) of each level; n is how many nodes of the level the group has."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}_run{k} AS (SELECT g, pos // 16 AS run, n, list(h ORDER BY pos) AS hs FROM {name}{k} WHERE n > 1 GROUP BY 1, 2, 3)")
        out.append(f"{name}{k + 1} AS (SELECT g, run AS pos, sha256(array_to_string(hs, '')) AS h, (n + 15) // 16 AS n FROM {name}_run{k})")
    out.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    return out


def _climb(last: str, name: str, levels: int, group: str, pos: str) -> list[str]:
    """Each step hashes f with what stands before and after it in its run, and adds that to the proof s."""
    out = []
    for k in range(levels):
        i = f"(({pos} // {16**k}) % 16)"
        before, after = f"array_to_string(r.hs[1:{i}], '')", f"array_to_string(r.hs[{i} + 2:], '')"
        out.append(f"{name}_up{k} AS (SELECT l.* REPLACE (CASE WHEN r.hs IS NULL THEN l.f ELSE sha256({before} || l.f || {after}) END AS f, CASE WHEN r.hs IS NULL THEN l.s ELSE l.s || {before} || {after} END AS s) FROM {last} l LEFT JOIN {name}_run{k} r ON r.g IS NOT DISTINCT FROM {group} AND r.run = {pos} // {16 ** (k + 1)})")
        last = f"{name}_up{k}"
    return out


def merkle_sql(levels: int = 5, top: int = 3) -> str:
    """For sources of up to 16**levels documents and up to 16**top sources."""
    leaves = f"leaves AS (SELECT doc_id, source AS g, {_leaf('text')} AS leaf, CASE WHEN {crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(f'''translate(text, '{_LOWER.upper()}', '{_LOWER}')''')} END AS changed FROM documents, bits)"
    placed = "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)"
    sources = "src AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree_root)"
    climbing = "go AS (SELECT p.doc_id, p.leaf, p.g, p.pos, s.pos AS spot, s.h AS subroot, coalesce(p.changed, p.leaf) AS f, '' AS s FROM placed p JOIN src s ON s.source IS NOT DISTINCT FROM p.g)"
    steps = [CRC_TABLE, leaves, placed, *_levels("SELECT g, pos, leaf AS h, n FROM placed", "tree", levels), sources, *_levels("SELECT 0 AS g, pos, h, n FROM src", "top", top), climbing]
    steps += _climb("go", "tree", levels, "l.g", "l.pos")
    steps += _climb(f"tree_up{levels - 1}", "top", top, "0", "l.spot")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM top_up{top - 1}, top_root t"
