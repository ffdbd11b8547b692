"""The opN_ queries: each applies one operator to its whole table and derives the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, media, ngram_join, pieces, quality, secrets, suffixes, tokens, warc
from ..shared import fresh_path
from .common import setting, table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.load(setting(spark, "pieces.model", pieces.MODEL))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = pieces.encode(docs, model, decoded="decoded")
    decoded = F.sha2("decoded", 256)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "ids", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archive(warc.decide_revisits(table(spark, sf_dir, "pages")), folder)
    read = warc.read_archive(spark, folder)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN p.page_id < r.m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < r.m THEN r.m END AS refers_to
FROM p LEFT JOIN r ON p.h = r.h
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, field)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.fingerprint_wav(media.encode_wav(docs, "text"), "media")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n, list(sh ORDER BY sh) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON x = u.doc_id JOIN n v ON y = v.doc_id WHERE 100 * o >= 85 * (u.n + v.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.root = e.x),
r AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n)
SELECT r.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, r.doc_id) AS class_id, component_id FROM r LEFT JOIN k ON r.doc_id = k.doc_id
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(mine).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    read = chat.read_windows(chat.format_windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: Windows are cut as ``chat`` documents it; the template's marks have 12, 1 and 11 characters, an escape adds one.
OP6_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
  greatest(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B]')), 1) AS n,
  24 + length(role) + len(regexp_extract_all(role, '<[|^]')) + 5 * len(regexp_extract_all(role, '\n')) + length(text) + len(regexp_extract_all(text, '<[|^]')) AS chars FROM m),
b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) - n AS before, first_value(role) OVER (PARTITION BY conv_id ORDER BY pos) = 'system' AS led FROM r),
w AS (SELECT conv_id, pos, before AS base, pos AS a FROM b WHERE pos = 0
  UNION ALL SELECT conv_id, pos, CASE WHEN o THEN before ELSE base END, CASE WHEN o THEN pos ELSE a END FROM (
    SELECT b.conv_id, b.pos, b.before, w.base, w.a, b.before // 32768 <> w.base // 32768 OR b.before + b.n - w.base > 512 AS o FROM w JOIN b ON w.conv_id = b.conv_id AND b.pos = w.pos + 1)),
h AS (SELECT s.conv_id, sum(b.chars) AS chars FROM w s JOIN b ON s.conv_id = b.conv_id AND s.pos = s.a AND s.a > 0
  AND ((led AND b.pos = 0) OR (b.pos < s.a AND b.pos >= CASE WHEN led THEN 1 ELSE 0 END AND b.before >= s.base - 128)) GROUP BY s.conv_id)
SELECT b.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(b.chars) + coalesce(any_value(h.chars), 0) AS BIGINT) AS formatted_chars
FROM b LEFT JOIN h ON b.conv_id = h.conv_id GROUP BY b.conv_id
"""


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    text = F.call_function("make_valid_utf8", F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))


OP7_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS times FROM g) WHERE times > 1),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 400 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o) GROUP BY doc_id, span),
t AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a) + 1, 1) AS f, a - 1 AS l FROM s
  UNION ALL SELECT d.doc_id, coalesce(m.z + 1, 1), octet_length(b) FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) m ON d.doc_id = m.doc_id),
p AS (SELECT k.doc_id, string_agg(CASE WHEN l >= f THEN hex(b[f:l]) ELSE '' END, '' ORDER BY f) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id),
-- The kept bytes as text: whatever is left of a character that was cut is one U+FFFD.
v AS (SELECT doc_id, kept, decode(unhex(array_to_string(list_transform(
  regexp_extract_all(kept, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|E.[89AB].|F.[89AB].[89AB].|F.[89AB].|..'),
  lambda c: CASE WHEN c < '8' OR (c >= 'C' AND len(c) = 2 * CASE WHEN c < 'E' THEN 2 WHEN c < 'F' THEN 3 ELSE 4 END) THEN c ELSE 'EFBFBD' END), ''))) AS text FROM p)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
  CAST(length(text) AS BIGINT) AS n_chars, text
FROM d LEFT JOIN t ON d.doc_id = t.doc_id JOIN v ON d.doc_id = v.doc_id
"""


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return leaks.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), fields=("source", "text"), vocabulary=setting(spark, "tokens.vocabulary", tokens.VOCABULARY))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.infer_grammar(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "grammar")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("grammar"))


def pieces_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by Viterbi over the piece scores; op1_pieces has the ids of the model's own rule, which differ."""
    model = pieces.PieceModel.load(setting(spark, "pieces.model", pieces.MODEL)).by_scores()
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


# What SQL can express of op4, op9 and op10, each from its operator's own output.


def media_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_media without its feature."""
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


#: The CRC goes over the last 32 bytes with a table of the polynomial 0xEDB88320, whose entries are computed here.
MEDIA_SQL = """
WITH t AS (SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(0 AS UBIGINT) FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entry FROM range(256) r(i)),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, n, h || repeat('FF', greatest(576, (n + 575) // 576 * 576) - n) AS h FROM d),
l AS (SELECT *, len(h) // 2 AS size, lpad(to_hex(len(h) // 2), 8, '0') AS a, lpad(to_hex(len(h) // 2 + 36), 8, '0') AS b FROM p),
m AS (SELECT *, unhex('52494646' || b[7:8] || b[5:6] || b[3:4] || b[1:2] || '57415645666D74201000000001000100401F0000401F00000100080064617461' || a[7:8] || a[5:6] || a[3:4] || a[1:2] || h) AS media FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [CAST('0x' || h[len(h) - 63 + 2 * k:len(h) - 62 + 2 * k] AS UBIGINT) FOR k IN range(32)]),
    lambda c, x: xor(entry[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) AS BIGINT) AS tail_crc32,
  CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256 FROM m, t
"""


def token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_tokens without its counts."""
    return op9_tokens(spark, sf_dir).select("doc_id", "field", "section", "start", "end")


#: The line feed that joins the fields belongs to the first one's last line.
SECTIONS_SQL = r"""
WITH f AS (SELECT doc_id, 'source' AS field, coalesce(source, '') AS body, 0 AS base FROM documents
  UNION ALL SELECT doc_id, 'text', coalesce(text, ''), length(coalesce(source, '')) + 1 FROM documents),
s AS (SELECT doc_id, field, base, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS section FROM (
  SELECT *, CASE WHEN body = '' THEN [''] ELSE regexp_extract_all(body, '[^
]*
|[^
]+$') END AS lines FROM f))
SELECT doc_id, field, CAST(section AS INTEGER) AS section, CAST(base + last - length(line) AS BIGINT) AS start, CAST(base + last + joined AS BIGINT) AS "end"
FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id, field ORDER BY section) AS last,
  CASE WHEN field = 'source' AND section = max(section) OVER (PARTITION BY doc_id, field) THEN 1 ELSE 0 END AS joined FROM s)
"""


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_secrets without the spans of its grammar."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?"""
#: A match starts after all that lies between the matches before it, and those matches.
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k AS (SELECT doc_id, 0 AS kind, 'assign' AS name, regexp_extract_all(x, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS found, regexp_split_to_array(x, '{_ASSIGN}[A-Za-z0-9+/_.=-]+') AS between FROM d
  UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(x, 'AKIA[A-Z0-9]+'), regexp_split_to_array(x, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(x, '[0-9a-f]+'), regexp_split_to_array(x, '[0-9a-f]+') FROM d),
m AS (SELECT doc_id, kind, name, unnest(found) AS s, unnest(between[1:len(found)]) AS b, generate_subscripts(found, 1) AS i FROM k),
p AS (SELECT *, sum(length(b) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS z FROM m),
g AS (SELECT *, z - length(s) AS a FROM p WHERE length(CASE WHEN kind = 0 THEN regexp_extract(s, '{_ASSIGN}(.*)', 2) ELSE s END) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, kind), '')) AS base_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_ngram_join": op5_ngram_join,
    "op6_chat": op6_chat,
    "op7_suffixes": op7_suffixes,
    "op8_decontam": op8_decontam,
    "op9_tokens": op9_tokens,
    "op10_secrets": op10_secrets,
    "pieces_viterbi": pieces_viterbi,
    "media_digests": media_digests,
    "token_sections": token_sections,
    "secrets_base": secrets_base,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op5_ngram_join": OP5_SQL, "op6_chat": OP6_SQL, "op7_suffixes": OP7_SQL, "media_digests": MEDIA_SQL, "token_sections": SECTIONS_SQL, "secrets_base": SECRETS_SQL}
