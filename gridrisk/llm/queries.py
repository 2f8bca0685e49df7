"""The corpus operators applied to the given tables, one query for each."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fim, langid, licenses, linededup, linkgraph, manifest, merkle, ngramjoin, secrets, tokenstore
from .common import bounded_batches, ensure_checkpoint_dir, read_table, two, with_next
from .registry import query


def held_out(id_col: str = "doc_id"):
    """Rows that the language query doesn't learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from the rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    judged = langid.identify(docs.select("doc_id", "text"), model, out="language")
    return judged.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score",
                         "language.rejected")


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    """Ids of every document by the rank file, and the bytes decoded from them."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents")
    out = bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)
    ids = F.array_join("ids", " ").cast("binary")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


OP9_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


@query("op9_decontamination", OP9_SQL)
def op9_decontamination(spark, sf_dir):
    """Words of every document that lie under a benchmark window, and the items found."""
    out = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_token_store")
def op2_token_store(spark, sf_dir):
    """Ids of every document written in grammar-compressed shards, and read back from them."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenizer = tokenstore.load_tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    tokenstore.write(read_table(spark, sf_dir, "documents"), path, tokenizer)
    return tokenstore.read(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


@query("op3_ngram_jaccard", OP3_SQL)
def op3_ngram_jaccard(spark, sf_dir):
    """Size of every document's shingle set and the component of its links."""
    out = ngramjoin.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP4_SQL = rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
             FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, k, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM raw),
p AS MATERIALIZED (SELECT doc_id, k, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM l WHERE s <> ''),
r AS (SELECT doc_id, pos, 3 AS n, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS run FROM p
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
      UNION ALL SELECT doc_id, pos, 1, s FROM p WHERE len(regexp_extract_all(s, '[^ \t\r\n\f\v]+')) >= {linededup.LONG_LINE}),
f AS (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) AS c FROM r WHERE run IS NOT NULL),
cut AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM f WHERE c > 1),
gone AS (SELECT doc_id, k FROM cut JOIN p USING (doc_id, pos)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) FILTER (s <> '') AS n_left
         FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_deleted,
       CASE WHEN c.n IS NULL THEN d.text WHEN coalesce(kept.n_left, 0) = 0 THEN '' ELSE kept.text END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark, sf_dir):
    """Every document without the lines of runs that occurred earlier; as in the SQL, two lines are no run."""
    return linededup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pairs=False)


def edited_text():
    """The text whose last half (rounded down) makes way for the first code points of the next one."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))


@query("op5_merkle_fingerprint")
def op5_merkle_fingerprint(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = two(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # fingerprints are made where the pairs lie: the texts alone are shuffled
    pairs = with_next(rows, ["text"]).withColumn("edited", edited_text()).withColumnRenamed("next_text", "next")
    pairs = pairs.select("*", F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
                         F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    bounded_batches(spark)
    out = merkle.compared(pairs, "text", ["edited", "next"], ["doc_id", "n_chars", "edited_sha256"])
    return out.drop("next_fingerprint")


def op7_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.TEMPLATES.items()))
    words = r"regexp_extract_all(lower({}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS MATERIALIZED (SELECT license, {pairs} AS tb FROM (SELECT license, {words.format("body")} AS w FROM (VALUES {templates}) v(license, body))),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*'), [text])) AS unit
          FROM documents WHERE text IS NOT NULL),
sets AS MATERIALIZED (SELECT doc_id, unit, {pairs} AS ub FROM (SELECT doc_id, unit, {words.format("unit")} AS w FROM units) WHERE len(w) > 1),
met AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice FROM sets JOIN t
        ON len(ub) BETWEEN {licenses.THRESHOLD} * len(tb) / (2 - {licenses.THRESHOLD}) - 1e-9
                       AND (2 - {licenses.THRESHOLD}) * len(tb) / {licenses.THRESHOLD} + 1e-9),
best AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, unit) AS top FROM met WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_units FROM best WHERE dice = top GROUP BY doc_id, license"""


@query("op7_license_scan", op7_sql())
def op7_license_scan(spark, sf_dir):
    """Licences that lines, paragraphs, whole documents or runs of lines match, one row for each document and licence."""
    out = licenses.scan(read_table(spark, sf_dir, "documents"), runs=True)
    return out.select(F.col("id").alias("doc_id"), "license", F.round("dice", 6).alias("dice"), "n_units")


def planted_turns(spark):
    """Conversation -7: both sides say the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :t AS text "
                     "UNION ALL SELECT -7L, 1L, 'assistant', :t", args={"t": text})


def op8_sql() -> str:
    said = r"\### Assistant: </turn> ok"
    esc = r"replace(replace(replace(replace({}, '\', '\\'), '<', '\l'), '>', '\g'), '#', '\h')"
    quota = chat.BUDGET - chat.HISTORY
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
n AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + {chat.MARK_TOKENS} AS n,
             {len("<turn >" + "</turn>") + 1} + length({esc.format("role")}) + length({esc.format("text")}) AS chars FROM c),
s AS (SELECT *, row_number() OVER o AS place, CAST(sum(n) OVER o AS BIGINT) - n AS before FROM n
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
t AS MATERIALIZED (SELECT *, before // {quota} + (before + n - 1) // {quota} AS win FROM s),
sys AS (SELECT conv_id, n AS sys_n, chars AS sys_chars FROM t WHERE place = 1 AND role = 'system'),
w AS MATERIALIZED (
  SELECT w.*, coalesce(sys_chars, 0) AS sys_chars, least({chat.HISTORY}, {chat.BUDGET} - size) - coalesce(sys_n, 0) AS room
  FROM (SELECT conv_id, win, min(before) AS start, sum(n) AS size FROM t GROUP BY ALL) w LEFT JOIN sys USING (conv_id)),
pieces AS (
  SELECT conv_id, chars FROM t UNION ALL
  SELECT conv_id, sys_chars FROM w WHERE start > 0 AND sys_chars > 0 UNION ALL
  SELECT t.conv_id, t.chars FROM t JOIN w ON t.conv_id = w.conv_id AND w.win > t.win AND w.start - t.before <= w.room
  WHERE NOT (t.place = 1 AND t.role = 'system')),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM pieces GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM t JOIN f USING (conv_id) GROUP BY conv_id"""


@query("op8_chat_windows", op8_sql())
def op8_chat_windows(spark, sf_dir):
    """Every conversation formatted in windows, and what is read back from them."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    w = chat.windows(rows.unionByName(planted_turns(spark)))
    turns = chat.read_turns(F.col("text"))
    turns = F.slice(turns, (F.col("n_repeated") + 1).cast("int"), F.size(turns) - F.col("n_repeated").cast("int"))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    w = w.select("conv", "window", F.size(turns).cast("long").alias("n"), said.alias("said"),
                 chat.read_loss(F.col("text"), F.col("loss")).alias("loss"), F.length("text").cast("long").alias("chars"))
    out = w.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"))
    said, loss = F.array_join(F.col("parts")["said"], ""), F.array_join(F.col("parts")["loss"], "")
    return out.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                      "formatted_chars")


#: Rules of the URL filter: verdict, host (and its subdomains), path prefix (fixed values).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_sql() -> str:
    """The rules and the propagation, iteration by iteration; ranks as in ``linkgraph.propagate``."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = linkgraph._LINK.replace("'", "''")
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"""
WITH RECURSIVE rules(verdict, rhost, prefix) AS (VALUES {rules}),
u AS MATERIALIZED (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (
  SELECT page_id, html, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
fits AS (
  SELECT page_id, first(rhost || prefix ORDER BY length(rhost || prefix) DESC) AS rule,
         first(verdict ORDER BY length(rhost || prefix) DESC) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix) GROUP BY page_id),
judged AS MATERIALIZED (SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN fits USING (page_id)),
links AS MATERIALIZED (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT host AS src, {low.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p)
  WHERE src <> '' AND src <> dst GROUP BY ALL),
seen AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0 END) AS allowed,
                avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0 END) AS blocked FROM judged WHERE host <> '' GROUP BY host),
target_rules AS (
  SELECT dst AS host, first(verdict ORDER BY length(rhost || prefix) DESC) AS verdict
  FROM (SELECT DISTINCT dst FROM links) JOIN rules ON (dst = rhost OR ends_with(dst, '.' || rhost)) AND prefix = '/' GROUP BY dst),
hosts AS MATERIALIZED (
  SELECT * FROM seen UNION ALL
  SELECT DISTINCT dst, CASE WHEN t.verdict = 'allow' THEN 1.0 ELSE 0 END, CASE WHEN t.verdict = 'block' THEN 1.0 ELSE 0 END
  FROM links LEFT JOIN target_rules t ON t.host = dst WHERE dst NOT IN (SELECT host FROM seen)),
t_share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM links),
d_share AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS share FROM links),
t0 AS (SELECT host, allowed AS seed, allowed AS rank FROM hosts), d0 AS (SELECT host, blocked AS seed, blocked AS rank FROM hosts)"""
    for k in "td":
        for i in range(linkgraph.ITERATIONS):
            text += f""",
{k}{i + 1} AS MATERIALIZED (SELECT h.host, h.seed, h.seed + {linkgraph.DAMPING} * coalesce(g.got, 0) AS rank FROM {k}0 h LEFT JOIN (
  SELECT dst, sum(rank * share) AS got FROM {k}_share JOIN {k}{i} ON src = host GROUP BY dst) g ON g.dst = h.host)"""
    n = linkgraph.ITERATIONS
    return text + f"""
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN d.rank - t.rank >= {linkgraph.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t{n} t ON t.host = j.host LEFT JOIN d{n} d ON d.host = j.host"""


@query("op10_url_filter", op10_sql())
def op10_url_filter(spark, sf_dir):
    """Verdict on every page's url by the rules, else by trust and distrust of its host."""
    out = linkgraph.judge(read_table(spark, sf_dir, "pages"), RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op11_secret_scan")
def op11_secret_scan(spark, sf_dir):
    """Secrets in every document: the plain patterns' spans, and those that decoding and parsing confirm."""
    out = secrets.scan(read_table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["kind"].isin(*secrets.PLAIN))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(F.col("id").alias("doc_id"), *[count(k) for k in secrets.PLAIN],
                      F.sha2(listed(plain).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OP12_SQL = r"""
WITH u AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
             CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
             array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", OP12_SQL)
def op12_fill_in_middle(spark, sf_dir):
    """Every document cut into lines and reordered around marks, and the text rebuilt from that."""
    out = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, crc32_7, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
         coalesce(strlen(text) || ':' || text, '-') AS body
  FROM (SELECT *, {crc} % 7 = 0 AS crc32_7 FROM documents)),
l AS MATERIALIZED (
  SELECT doc_id, lang, leaf, candidate, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || n || body) AS leaf, sha256(head || CASE WHEN crc32_7 THEN n1 ELSE n END || body) AS candidate FROM f)),
t AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM l
      UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
s AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS gn FROM t WHERE n = 1),
r AS (SELECT 0 AS lvl, g AS pos, gn AS n, subroot AS h FROM s
      UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY lvl, pos // 2, n),
lh AS (SELECT lang, max(lvl) AS height FROM t GROUP BY lang),
nodes AS MATERIALIZED (  -- every leaf's steps: level by level the sibling and its side
  SELECT l.doc_id, l.leaf, x.lvl, (l.pos >> x.lvl) AS spot, o.h AS sibling
  FROM l JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) x ON x.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM l.lang AND o.lvl = x.lvl AND o.pos = xor(l.pos >> x.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, 1000 + x.lvl, (s.g >> x.lvl), o.h
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lvl FROM r WHERE n > 1) x ON true
  LEFT JOIN r o ON o.lvl = x.lvl AND o.pos = xor(s.g >> x.lvl, 1)),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lvl) AS k FROM nodes),
fold AS (SELECT doc_id, leaf, CAST(0 AS BIGINT) AS k, candidate AS h FROM l
         UNION ALL SELECT f.doc_id, f.leaf, f.k + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN spot % 2 = 1 THEN sibling || h ELSE h || sibling END)
         FROM fold f JOIN steps p ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.leaf = f.leaf AND p.k = f.k + 1),
ends AS (SELECT doc_id, leaf, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id, leaf),
proofs AS (SELECT doc_id, leaf, string_agg(sibling, '' ORDER BY k) AS proof FROM steps GROUP BY doc_id, leaf)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM r WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM r WHERE n = 1) AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ends e ON e.doc_id IS NOT DISTINCT FROM l.doc_id AND e.leaf = l.leaf
LEFT JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf"""

#: DuckDB has no CRC-32: bit by bit over the id's decimal text.
_CRC = """coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, c: list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295), 1)"""


@query("op13_merkle_manifest", OP13_SQL.replace("{crc}", _CRC))
def op13_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and the root that its possibly tampered leaf folds to."""
    docs = read_table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, manifest.leaf(more))
    out = manifest.build(docs, columns, "doc_id", "lang", candidate=tampered).proofs
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                      F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
