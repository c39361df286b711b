"""DuckDB twins of the queries that SQL can express.

The others have none: expectation-maximisation, trained models, sketches, tokenizers and the edit
distance of all windows; tests hold those against brute-force versions.
"""

from __future__ import annotations

from . import merkle_sql
from .license_scan import PERCENT, TEMPLATES, template_bigrams, template_words

_CONTROL = r"(<)(\||/?s>|</?SYS>>|</SYS>>)|(\[)(/?INST\])"


def _escaped_chars(column: str) -> str:
    return rf"length(regexp_replace(replace({column}, '\', '\s'), '{_CONTROL}', '\1\3__\2\4', 'g'))"


CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS body FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]') x),
p AS (SELECT *, 13 + {_escaped_chars('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_chars('body')} AS chars FROM t),
s AS (SELECT *, sum(chars) OVER w AS stop, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||body||chr(10), '' ORDER BY n)) AS turns_sha256, CAST(sum(CASE WHEN role='assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN body END, '' ORDER BY n),'')) AS loss_sha256, CAST(sum(CASE WHEN role='assistant' OR n=total THEN stop ELSE 0 END) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    rows = ",\n".join(f"({k}, {_quoted(name)}, {len(template_words(text))}, [{', '.join(map(_quoted, template_bigrams(text)))}])" for k, (name, text) in enumerate(TEMPLATES))
    return f"""WITH tp AS (SELECT * FROM (VALUES {rows}) v(k, license, width, pairs)),
d AS (SELECT doc_id, coalesce(text,'') AS text, string_split(coalesce(text,''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, 0 AS unit, text AS part FROM d UNION ALL SELECT doc_id, unnest(range(1, len(ls)+1)), unnest(ls) FROM d WHERE len(ls)>1),
w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x<>'') AS ws FROM u),
b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i]||' '||ws[i+1])) AS own FROM w WHERE len(ws)>1),
s AS (SELECT doc_id, unit, license, k, len(own) AS n, 2.0*len(list_intersect(own, pairs))/(len(own)+len(pairs)) AS dice FROM b JOIN tp ON 200*least(len(own), len(pairs)) >= {PERCENT}*(len(own)+len(pairs))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, k) AS rn FROM s WHERE dice*100 >= {PERCENT}),
dw AS (SELECT doc_id, ws, list_transform(range(1, len(ws)), lambda i: ws[i]||' '||ws[i+1]) AS ps FROM w WHERE unit=0 AND len(ws)>1),
pp AS (SELECT doc_id, unnest(range(1, len(ps)+1)) AS spot, unnest(ps) AS pair FROM dw), tb AS (SELECT k, unnest(pairs) AS pair FROM tp),
h AS (SELECT doc_id, k, spot, pair FROM pp JOIN tb USING (pair)),
en AS (SELECT doc_id, k FROM h JOIN tp USING (k) GROUP BY doc_id, k HAVING count(DISTINCT pair)*{200 - PERCENT} >= {PERCENT}*any_value(len(pairs))),
wi AS (SELECT h.doc_id, h.k, h.spot, tp.license, tp.pairs, list_distinct(dw.ps[h.spot : h.spot+tp.width-2]) AS own FROM h JOIN en USING (doc_id, k) JOIN tp USING (k) JOIN dw ON dw.doc_id=h.doc_id),
wv AS (SELECT doc_id, k, spot, license, len(own) AS n, 2.0*len(list_intersect(own, pairs))/(len(own)+len(pairs)) AS dice FROM wi),
wr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, spot) AS rn FROM wv WHERE dice*100 >= {PERCENT})
SELECT doc_id, CASE WHEN unit=0 THEN 'text' ELSE 'line' END AS kind, CAST(unit AS BIGINT) AS unit, license, CAST(k AS BIGINT) AS template, round(CAST(dice AS DOUBLE),9) AS dice, CAST(n AS BIGINT) AS n_bigrams FROM r WHERE rn=1
UNION ALL SELECT doc_id, 'window', CAST(spot-1 AS BIGINT), license, CAST(k AS BIGINT), round(CAST(dice AS DOUBLE),9), CAST(n AS BIGINT) FROM wr WHERE rn=1"""


NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x<>'') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<3 THEN [array_to_string(ws,' ')] ELSE list_distinct(list_transform(range(1, len(ws)-1), lambda i: ws[i]||' '||ws[i+1]||' '||ws[i+2])) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id=x JOIN s b ON b.doc_id=y WHERE 100*c >= 85*(len(a.sh)+len(b.sh)-c)), m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, m.y FROM r JOIN m ON m.x=r.y), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id=component_id AS kept FROM s JOIN c ON c.x=s.doc_id"""


EXACT_DUPLICATES = """WITH t AS (SELECT doc_id, coalesce(text,'') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST)=1 AS kept, sha256(text) AS text_sha256 FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT, "op5_license_scan": license_sql(), "op8_minhash_dedup": NEAR_DUPLICATES, "op11_merkle_manifest": merkle_sql.MANIFEST, "op12_exact_dedup": EXACT_DUPLICATES}
