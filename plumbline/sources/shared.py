"""Relations in the shapes of prompts, locators, plans and reviews, derived from the tables by SQL that any engine runs.

``RELATIONS`` maps a name to the tables it needs and its SQL, in which tables stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tables

#: The eight sections of a public prompt, in order (fixed values).
MARKERS = (
    "Original statement", "Original question", "Original answer options", "Evidence locations and candidates",
    "Images and locator views", "Local question", "Output format", "Local reading information",
)

_CANDIDATES = "concat('{\"alias\":\"E1\",\"locators\":[{\"kind\":\"visual\",\"ref\":\"v1\"},{\"kind\":\"text\",\"ref\":\"t1\"}]}', " + ", ".join(
    f"CASE WHEN p_size%3>={k - 2} THEN ',{{\"alias\":\"E{k}\",\"locators\":[{{\"kind\":\"{'text' if k == 3 else 'visual'}\",\"ref\":\"r{k}\"}}]}}' ELSE '' END" for k in (2, 3, 4)
) + ")"


def _section(k: int, body: str) -> str:
    return f"'[{MARKERS[k]}]', chr(10), {body}"


_GOOD = ", chr(10), ".join(_section(k, b) for k, b in enumerate(("statement", "question", "'A or B'", "evidence", "legend", "local_question", "'{\"owner\":string}'", "'None.'")))
_MISSING = ", chr(10), ".join(_section(k, b) for k, b in enumerate(("statement", "question", "'A or B'", "evidence", "legend", "local_question", "'{\"owner\":string}'")))
_TWICE = f"{_GOOD}, chr(10), {_section(1, 'question')}"
_SWAPPED = ", chr(10), ".join((_section(1, "question"), _section(0, "statement"), *(_section(k, b) for k, b in ((2, "'A or B'"), (3, "evidence"), (4, "legend"), (5, "local_question"), (6, "'x'"), (7, "'None.'")))))

RELATIONS: dict[str, tuple[str, str]] = {
    # One prompt per part; faults 7, 8 and 9: a section lacks, occurs twice, stands elsewhere.
    "prompts": (
        "part",
        f"""SELECT item, fault, n_candidates, statement, question, evidence, legend, local_question,
  CASE fault WHEN 7 THEN concat({_MISSING}) WHEN 8 THEN concat({_TWICE}) WHEN 9 THEN concat({_SWAPPED}) ELSE concat({_GOOD}) END AS user_text
FROM (SELECT p_partkey AS item, p_partkey%10 AS fault, 2+p_size%3 AS n_candidates, concat('A block named ', p_name, ' slides.', chr(10), 'It stops [not a section].') AS statement,
  concat('What is the mass of ', p_brand, '?') AS question,
  concat('{{"anchors":{{"A1":{{"kind":"', CASE WHEN p_size>40 THEN 'text' ELSE 'visual' END, '","ref":"a1"}},"A2":{{"kind":"text","ref":"a2"}}}},"candidates":[', {_CANDIDATES}, ']}}') AS evidence,
  concat('Views follow.', chr(10), 'Original image IDs: i1', CASE WHEN p_size%2=0 THEN ', i2' ELSE '' END, CASE WHEN p_partkey%13=0 THEN ' ,i1' ELSE '' END, chr(10), 'End.') AS legend,
  concat('Is E1 heavier than E2 (not E10, xE1 or E1_a)? See E', 1+p_size%4, '.') AS local_question FROM {{part}}) x""",
    ),
    # Text locators on turns; kind 1: beyond the end, kind 2: another quote, else right.
    "locators": (
        "conversations",
        """SELECT conv_id, turn, text, kind, first, CASE WHEN kind=1 THEN length(text)+3 ELSE first+4 END AS stop, CASE WHEN kind=2 THEN 'zzzz' ELSE substr(text, first+1, 4) END AS quote
FROM (SELECT conv_id, turn, text, CASE WHEN conv_id%11=0 THEN 1 WHEN (conv_id+turn)%7=0 THEN 2 ELSE 0 END AS kind, CAST((conv_id*7+turn)%10 AS INT) AS first FROM {conversations} WHERE length(text)>=20) x""",
    ),
    # Review actions in order: edits and rejections reopen a stage, approvals close it.
    "actions": (
        "events",
        """SELECT user_id AS record, CAST(event_id%4+1 AS INT) AS stage, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'approve' WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'edit' END AS action FROM {events}""",
    ),
    # A journal whose records name the hash of the one before; every 50th link is broken.
    "journal": (
        "events",
        """SELECT user_id AS chain, event_id AS seq, event_type AS kind, event_id%50=7 AS broken FROM {events}""",
    ),
    # Physical entities with types, and the identity edges between them.
    "entities": ("part", "SELECT p_partkey AS entity, p_type AS kind FROM {part}"),
    "same_entity": ("part", "SELECT p_partkey AS a, p_partkey+10 AS b FROM {part} WHERE p_partkey%3=0 AND p_partkey+10<=(SELECT max(p_partkey) FROM {part})"),
    # Attachments of items; items of a mother share them unless the supplier says otherwise.
    "attachments": (
        "lineitem",
        "SELECT l_orderkey AS mother, l_linenumber AS probe, concat('img', l_orderkey%5, CASE WHEN l_suppkey%9=0 THEN 'x' ELSE '' END) AS first_image, CASE WHEN l_orderkey%2=0 THEN concat('img', l_orderkey%7) END AS second_image FROM {lineitem}",
    ),
    # Settings of adapters as nested JSON; keys of credentials stand at several depths, in several cases, and as plain values.
    "settings": (
        "customer",
        """SELECT c_custkey AS id, concat('{{"name":"', c_name, '","segment":"', c_mktsegment, '","nation":', c_nationkey, ',"balance":', CAST(floor(c_acctbal) AS BIGINT), CASE WHEN c_nationkey=7 THEN ',"extra":null' ELSE '' END,
  CASE WHEN c_nationkey%6=0 THEN ',"password_hint":"password"' ELSE '' END, ',"models":[{{"id":"m', c_custkey%5, '","limits":{{"tokens":', c_custkey%700, CASE WHEN c_nationkey=3 THEN ',"API_Key":"x"' ELSE '' END, '}}}}',
  CASE WHEN c_nationkey%4=1 THEN concat(',{{"id":"', c_mktsegment, '","inner":[{{"limits":{{"tokens":-1}}}},{{"Secret":null,"id":2.5}}]}}') ELSE '' END, ']', CASE WHEN c_nationkey=11 THEN ',"name":"twice"' ELSE '' END, '}}') AS record, c_name, c_mktsegment, c_nationkey, c_acctbal
FROM {customer}""".replace("{{", "{").replace("}}", "}"),
    ),
    # Records of a review store before and after a rebuild: lines go, come and change; ``seen`` changes in every record and means nothing.
    "review_store": (
        "orders",
        """SELECT id, version, concat('{"seen":"', version, '-', id, '","state":"', state, '","priority":"', o_orderpriority, '","refs":[', o_custkey, ',', o_custkey%7, ']}') AS record, state, o_orderpriority, o_custkey
FROM (SELECT o_orderkey AS id, 'before' AS version, o_orderstatus AS state, o_orderpriority, o_custkey FROM {orders} WHERE substr(o_orderpriority,1,1)<>'5' OR o_custkey%11<>4
  UNION ALL SELECT o_orderkey, 'after', CASE WHEN o_orderstatus='P' AND o_custkey%5=2 THEN 'settled' ELSE o_orderstatus END, o_orderpriority, o_custkey FROM {orders} WHERE substr(o_orderpriority,1,1)<>'1' OR o_custkey%13<>6) x""",
    ),
    # Batch outputs of four stages in one JSON text; some lack a stage, have one too many, or don't agree on the problem.
    "batches": (
        "customer",
        """SELECT c_custkey AS id, c_nationkey, c_mktsegment, c_name, CASE WHEN c_nationkey=2 THEN concat('[', c_custkey, ']') ELSE concat('{"pass1":{"problem_id":', CASE WHEN c_nationkey=17 THEN '""' WHEN c_nationkey=18 THEN 'null' ELSE concat('"p', c_custkey, '"') END, ',"nodes":[', c_nationkey, ',1]}',
  ',"pass2":{"problem_id":"p', c_custkey, '","label":"', c_mktsegment, '"}', ',"pass3":{"problem_id":"', CASE WHEN c_nationkey=4 THEN 'q' ELSE 'p' END, c_custkey, '"}', CASE WHEN c_nationkey=9 THEN '' ELSE concat(',"pass4":{"problem_id":"p', c_custkey, '","by":"', c_name, '"}') END,
  CASE WHEN c_nationkey=13 THEN ',"pass9":{}' ELSE '' END, '}') END AS record FROM {customer}""",
    ),
    # Image files as hex text, with what their records declare: PNG, JPEG with and without fill bytes and other segments, and broken ones.
    "image_files": (
        "part",
        """SELECT path, shape, want_mime, want_width, want_height, width, height, CASE shape WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', w8, h8, '0806000000', '00000000') WHEN 1 THEN concat('89504E470D0A1A0A0000000D74455874', w8, h8, '0806000000', '00000000')
  WHEN 2 THEN concat('FFD8', 'FFE00004AAAA', 'FFFFFFDB0003BB', 'FFC2000B08', h4, w4, '01011100', 'FFDA') WHEN 3 THEN concat('FFD8FF01FFD0FFC4000300FFC0000808', h4, w4, 'FF', 'FFD9') WHEN 4 THEN concat('FFD8FFE00004AAAAFFDA0003BB', h4, w4)
  WHEN 5 THEN concat('FFD8', 'FFE0F004', w4, h4) WHEN 6 THEN concat('FFD8FFC00007', h4, w4, '000000') WHEN 7 THEN concat('FFD8', 'FFE00004AAAA', 'BB', h4, w4) WHEN 8 THEN concat('FFD8', 'FFE00004AAAA', 'FFFFFF') WHEN 9 THEN concat('474946383961', w4, h4) END AS hex
FROM (SELECT *, lpad(hexed_w, 8, '0') AS w8, lpad(hexed_h, 8, '0') AS h8, lpad(hexed_w, 4, '0') AS w4, lpad(hexed_h, 4, '0') AS h4 FROM (SELECT concat('img/', p_partkey, '.bin') AS path, CAST(length(p_name)*p_size%11 AS INT) AS shape, CASE WHEN p_brand='Brand#13' THEN 'image/gif' WHEN length(p_name)*p_size%11<2 THEN 'image/png' ELSE 'image/jpeg' END AS want_mime,
  CAST(floor(p_retailprice) AS BIGINT) AS want_width, CAST(p_size AS BIGINT) AS want_height, CAST(floor(p_retailprice) AS BIGINT)+CASE WHEN p_size=9 THEN 1 ELSE 0 END AS width, CAST(p_size AS BIGINT) AS height, hex(CAST(floor(p_retailprice) AS BIGINT)+CASE WHEN p_size=9 THEN 1 ELSE 0 END) AS hexed_w, hex(CAST(p_size AS BIGINT)) AS hexed_h FROM {part}) x) y""",
    ),
    # Sources of records with nullable image slots, an answer that may be JSON, and options with ids or labels.
    "sources": (
        "customer",
        """SELECT c_custkey AS source, CASE WHEN c_custkey%3=0 THEN concat('a/', c_name, '.png') END AS image_1, CASE WHEN c_custkey%4<>1 THEN concat('b/', c_name, '.png') END AS image_2, CASE WHEN c_custkey%10=0 THEN '../up.png' WHEN c_custkey%6=0 THEN concat('A/', c_name, '.PNG') END AS image_3,
  CASE c_custkey%4 WHEN 0 THEN concat('{"answer":"', c_mktsegment, '"}') WHEN 1 THEN c_mktsegment WHEN 2 THEN concat('{"answer":', c_custkey, '}') ELSE concat('{broken ', c_custkey) END AS reference, c_mktsegment AS segment FROM {customer}""",
    ),
}


#: Tables whose few bytes become long texts.
NARROW = ("part", "customer")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs, text = RELATIONS[name]
    for t in needs.split():
        text = text.replace("{" + t + "}", f"plumbline_{t}")
        table = tables.load(spark, sf_dir, t)
        (tables.spread(table) if t in NARROW else table).createOrReplaceTempView(f"plumbline_{t}")
    return spark.sql(text)


def duck(names: str, body: str) -> str:
    """``body`` for DuckDB, with the named relations (blank-separated) before it."""
    out = []
    for n in names.split():
        needs, text = RELATIONS[n]
        for t in needs.split():
            text = text.replace("{" + t + "}", t)
        out.append(f"{n} AS ({text})")
    body = body.strip()
    return "WITH " + ("RECURSIVE " if "RECURSIVE" in body[:20] else "") + ",\n".join(out) + (",\n" + body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body)
