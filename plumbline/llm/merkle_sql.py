"""The manifest of ``merkle`` in DuckDB's SQL: levels by a recursive query, folds by list functions."""

from __future__ import annotations


def _part(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR)||':'||{text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + "||".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, c: list_reduce(list_concat([xor(crc, c)], [CAST(0 AS BIGINT) FOR b IN range(8)]), lambda v, z: xor(v//2, CASE WHEN v%2=1 THEN 3988292384 ELSE 0 END))))"""


def _tree(name: str, leaves: str) -> str:
    """Levels ``name`` (tree, lvl, pos, n, h) over leaves (tree, pos, n, h), and ``name``_s: left and right of every node that has a parent."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL SELECT tree, lvl+1, pos//8, (n+7)//8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n>1 GROUP BY tree, lvl, pos//8, n),
{name}_r AS (SELECT tree, lvl, pos//8 AS up, list(h ORDER BY pos) AS hs FROM {name} WHERE n>1 GROUP BY tree, lvl, pos//8),
{name}_s AS (SELECT a.tree, a.lvl, a.pos, array_to_string(hs[1:pos%8],'') AS l, array_to_string(hs[pos%8+2:8],'') AS r FROM {name} a JOIN {name}_r b ON a.tree=b.tree AND a.lvl=b.lvl AND a.pos//8=b.up)"""


MANIFEST = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('='||lang,'') AS tree, {_leaf("text")} AS h,
  CASE WHEN {_CRC}%3=0 THEN {_leaf(_LOW)} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rid)-1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree("t", "p")},
q AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree)-1 AS pos, count(*) OVER () AS n, h, tree AS name FROM t WHERE n=1),
{_tree("u", "q")},
steps AS (SELECT rid, s.lvl, s.l, s.r FROM p JOIN t_s s ON p.tree=s.tree AND p.pos//CAST(8**s.lvl AS BIGINT)=s.pos
  UNION ALL SELECT rid, 100+s.lvl, s.l, s.r FROM p JOIN q ON q.name=p.tree JOIN u_s s ON q.pos//CAST(8**s.lvl AS BIGINT)=s.pos),
paths AS (SELECT rid, list(l||'|'||r ORDER BY lvl) AS path, string_agg(l||r, '' ORDER BY lvl) AS flat FROM steps GROUP BY rid),
f AS (SELECT doc_id, p.h AS leaf, q.h AS subroot, (SELECT h FROM u WHERE n=1) AS root, sha256(coalesce(flat,'')) AS proof_sha256,
  list_reduce(list_concat([coalesce(changed, p.h)], coalesce(path, [])), lambda x, s: sha256(split_part(s,'|',1)||x||split_part(s,'|',2))) AS folded_root
  FROM p JOIN q ON q.name=p.tree LEFT JOIN paths USING (rid))
SELECT *, folded_root=root AS verified FROM f"""
