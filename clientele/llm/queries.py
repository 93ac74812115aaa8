"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clientele.llm import chat, covertree, files, mixing, ngramjoin, packing, permindex, quality, randomness, ranked, tokencount, toxicity, trie, warc
from clientele.session import scratch_dir

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EOD = 50256                       # <|endoftext|> of the byte-level vocabulary


def query(key: str, sql: str | None = None):
    def add(plan):
        PLANS[key] = plan
        if sql is not None:
            SQL[key] = sql
        return plan
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- 2: chat formatting

TRICKY = "\\### Assistant: </turn> ok"
STREAMED_CHARS = 1000

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS r,
         replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || r || ': ' || x || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log behind stored conversations: a row opens its turn; what an assistant says
    then streams in as deltas. Rows are numbered by turn, role and text, so each row
    is a turn of its own even where turn numbers repeat."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), "turn",
                                F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("turn", F.row_number().over(order).cast("long"))
    streams = F.col("role") == "assistant"
    deltas = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STREAMED_CHARS}}}"), F.lit(0))
    parts = F.when(streams, F.concat(F.array(F.lit("")), deltas)).otherwise(F.array("text"))
    return rows.select("conv_id", "turn", "role", F.posexplode(parts).alias("k", "text")).select(
        "conv_id", F.col("k").cast("long").alias("seq"), "turn",
        F.when(F.col("k") == 0, "message").otherwise("delta").alias("kind"), "role", "text")


@query("op2_chat_formatting", _CHAT_SQL)
def chat_formatting(spark, sf_dir):
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chat.digests(chat.read_chats(chat.format_chats(conversation_events(rows))))


# ---------------------------------------------------------------- 3: web archives

_WARC_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
k AS (SELECT *, payload_bytes >= 100 AND first_id <> page_id AS again FROM m)
SELECT page_id, TRUE AS intact, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM k
"""


@query("op3_warc", _WARC_SQL)
def warc_round_trip(spark, sf_dir):
    folder = scratch_dir(spark, "warc")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    warc.write_warc(read(spark, sf_dir, "pages"), folder, f"{folder}-digests", shards)
    return warc.resolved(warc.read_warc(spark, folder), f"{folder}-records").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


# ---------------------------------------------------------------- 4: best-fit packing

@query("op4_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer_path(), scratch_dir(spark, "pieces"))


# ---------------------------------------------------------------- 7: token counts

@query("op7_token_counts")
def token_counts(spark, sf_dir):
    folder = scratch_dir(spark, "tokens")
    listing = f"{folder}-listing"
    tokencount.write_token_files(read(spark, sf_dir, "documents"), folder, tokenizer_path(), EOD).write.parquet(listing)
    files.drop_temporary(folder)
    counted = tokencount.scan_separators(spark, folder, EOD)
    return counted.join(spark.read.parquet(listing), ["file", "ordinal"], "left").select(
        "doc_id", "n_tokens", "file", "ordinal", "start", "closed")


# ---------------------------------------------------------------- 1, 5: scores

@query("op1_quality_classifier")
def quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.quality_model(docs, read(spark, sf_dir, "labels")))


@query("op5_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, read(spark, sf_dir, "labels")))


# ---------------------------------------------------------------- 6, 8: vectors

_NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""


@query("op6_embedding_near_dedup", _NEAR_VECTORS_SQL)
def embedding_near_dedup(spark, sf_dir):
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op8_approximate_neighbours")
def approximate_neighbours(spark, sf_dir):
    folder, vectors = scratch_dir(spark, "permutations"), read(spark, sf_dir, "embeddings")
    pivots = permindex.build_index(vectors, f"{folder}/index")
    return permindex.search(spark.read.parquet(f"{folder}/index"), pivots, vectors.where("vec_id % 100 = 0"),
                            f"{folder}/found")


# ---------------------------------------------------------------- 10: mixing

# Languages of rows labelled good and harmless, and one domain for all other labelled rows.
FLAGGED = "flagged"
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, FLAGGED: 0.05}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label): the domain of every labelled document."""
    good = labels.groupBy("doc_id").agg(((F.max("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    return docs.select("doc_id", "lang").join(good, "doc_id").select(
        "doc_id", F.when(F.col("good"), F.col("lang")).otherwise(FLAGGED).alias("label")).where(
        F.col("label").isin(list(WEIGHTS))).groupBy("doc_id").agg(F.min("label").alias("label"))


def domain_model(spark: SparkSession, sf_dir: str) -> mixing.Domains:
    docs = read(spark, sf_dir, "documents")
    return mixing.learn_domains(docs, domain_labels(docs, read(spark, sf_dir, "labels")), list(WEIGHTS))


@query("op10_mixing")
def mixing_rates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_dir(spark, "memberships")
    domains = domain_model(spark, sf_dir)
    mixing.memberships(docs, domains, tokenizer_path()).drop("text").write.parquet(folder)
    members = spark.read.parquet(folder)
    rate = mixing.fit_rates(members, domains.names, WEIGHTS, shrinking=(FLAGGED,), keep_from=mixing.KEEP_FROM)
    return members.select("doc_id", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{n}") for k, n in enumerate(domains.names)],
                          rate.alias("rate"), mixing.copies(rate).alias("copies"))


# ---------------------------------------------------------------- 9: n-gram Jaccard join

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM documents)),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END) AS g
      FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents JOIN c ON id = doc_id LEFT JOIN n USING (doc_id)
"""


@query("op9_ngram_jaccard_join", _JACCARD_SQL)
def ngram_jaccard_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.joined(docs, scratch_dir(spark, "jaccard")).select("doc_id", "n_shingles", "component_id")


# ---------------------------------------------------------------- 11: prefix trie

SHARED_BLOCK, SHARED_TURNS = 100, 6      # conversations c to c + 99 may begin like c; by fewer turns than this

_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit: the register is divided by the reversed polynomial
c AS (
  SELECT conv_id, max(i) AS n, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                             lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, i AS d, role, text FROM c JOIN t ON t.conv_id = base AND i <= h
  UNION ALL
  SELECT c.conv_id, i - h + least(h, coalesce(b.n, 0)), role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND i > h LEFT JOIN (SELECT conv_id, n FROM c) b ON b.conv_id = base),
p AS (
  SELECT conv_id, d, length(text) AS size,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
q AS (SELECT conv_id, d, size, path, max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = d), '')) AS ends_sha256
  FROM q GROUP BY path),
k AS (SELECT n.*, up.conv_id AS parent_conv_id, up.path AS above
      FROM n LEFT JOIN n up ON n.depth = up.depth + 1 AND n.path[1:n.depth - 1] = up.path),
f AS (SELECT k.*, (SELECT count(*) FROM k x WHERE x.above = k.path AND x.depth = k.depth + 1) AS n_children FROM k)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, f.ends_sha256,
       count(*) FILTER (s.n_children = 0) AS n_leaves, CAST(sum((s.n_convs - 1) * s.size) AS BIGINT) AS saved_tokens
FROM f JOIN f s ON s.depth >= f.depth AND s.path[1:f.depth] = f.path
GROUP BY ALL
"""


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation with its first turns replaced by those of the
    first conversation of its block, none if that one is missing."""
    own = trie.ordered_turns(conversations)
    block = F.col("conv_id") % SHARED_BLOCK
    first = own.where(block == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("_first"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    begin = F.slice("_first", F.lit(1), F.col("_h"))
    return own.withColumns({"_base": F.col("conv_id") - block, "_h": shared}).join(first, "_base", "left").select(
        "conv_id", F.when(F.col("_first").isNull(), rest).otherwise(F.concat(begin, rest)).alias("turns"))


@query("op11_prefix_trie", _TRIE_SQL)
def prefix_trie(spark, sf_dir):
    return trie.prefix_trie(rebuilt_conversations(read(spark, sf_dir, "conversations")), scratch_dir(spark, "trie"))


# ---------------------------------------------------------------- 12: secrets


def _secrets_sql() -> str:
    """The battery restated over lists. Positions come from the pieces between matches."""
    r = randomness
    quoted = {k: p.replace("'", "''") for k, p in {"assign": r.ASSIGN, "access": r.ACCESS, "hex": r.HEX, "random": r.TOKEN}.items()}
    kinds = " UNION ALL ".join(
        f"""SELECT id, {i} AS kind, unnest(range(1, len(f) + 1)) AS i, f, string_split_regex(text, '{p}') AS g
            FROM (SELECT id, text, regexp_extract_all(text, '{p}') AS f FROM d)""" for i, p in enumerate(quoted.values()))

    def pick(column) -> str:
        whens = " ".join(f"WHEN regexp_matches(body, '{e[1]}') THEN {column(k, *e[2:])}" for k, e in enumerate(r.ENCODINGS[:-1]))
        return f"CASE {whens} ELSE {column(len(r.ENCODINGS) - 1, *r.ENCODINGS[-1][2:])} END"

    family = " + ".join(f"CAST(n >= {bound} AS INT)" for bound in r.LENGTHS)
    names = "['" + "', '".join(r.KINDS) + "']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT id, kind, f[i] AS found, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM ({kinds})),
spans AS (SELECT id, kind, found, start, start + length(found) AS stop FROM s
          WHERE kind <> 0 OR length(regexp_extract(found, '{quoted["assign"]}', 2)) >= {r.VALUE_CHARS}),
b AS (SELECT *, rtrim(found, '=') AS body FROM spans WHERE kind = 3),
e AS (SELECT *, CAST(length(body) AS DOUBLE) AS n, {pick(lambda k, a, e, c: k)} AS enc, {pick(lambda k, a, e, c: f"'{a}'")} AS alphabet,
             {pick(lambda k, a, e, c: f"{e}::DOUBLE")} AS eq, {pick(lambda k, a, e, c: f"{c}::DOUBLE")} AS ch FROM b),
f AS (SELECT *, CASE enc WHEN 5 THEN translate(body, '-_', '+/') WHEN 3 THEN body ELSE lower(body) END AS folded FROM e),
m AS (SELECT *, list_transform(string_split(folded, ''), lambda c: 2 * strpos(alphabet, c) - 1 - length(alphabet)) AS v,
             list_sum(list_transform(string_split(alphabet, ''),
                      lambda c: (length(folded) - length(replace(folded, c, ''))) ** 2)) AS squares,
             len(regexp_extract_all(folded, '{r.CLASS_RUNS}')) AS runs FROM f),
z AS (SELECT *, (eq - (squares - n) / (n * (n - 1))) / sqrt(2 * eq * (1 - eq) / (n * (n - 1)) + 4 * {r.CUBES}::DOUBLE * eq * eq / n) AS z1,
             CASE WHEN ch > 0 THEN ((runs - 1) / (n - 1) - ch) / sqrt(ch * (1 - ch) / (n - 1)) ELSE 0 END AS z2,
             list_sum(list_transform(v, lambda x: x * x)) AS total,
             list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1])) AS pairs FROM m),
w AS (SELECT *, ({r.CORRELATION}::DOUBLE - abs(CASE WHEN total > 0 THEN CAST(pairs AS DOUBLE) / CAST(total AS DOUBLE) ELSE 1 END)) * sqrt(n) AS z3 FROM z),
u AS (SELECT *, CASE WHEN z1 > 0 THEN z1 * z1 / 2 ELSE 0 END + CASE WHEN z2 > 0 THEN z2 * z2 / 2 ELSE 0 END
             + CASE WHEN z3 > 0 THEN z3 * z3 / 2 ELSE 0 END AS weight FROM w),
l AS (SELECT id, kind, start, stop, enc * {len(r.LENGTHS) + 1} + {family} AS family,
             least(floor((weight - ln(1 + weight + weight * weight / 2)) * {r.STEPS}), {r.LEVELS}) AS level FROM u),
k AS (SELECT family, level, sum(count(*)) OVER (PARTITION BY family) AS everything,
             sum(count(*)) OVER (PARTITION BY family ORDER BY level DESC) AS found FROM l GROUP BY family, level),
t AS (SELECT family, min(level) AS least_level FROM k WHERE everything * exp(-level / {r.STEPS}) <= {r.RATE}::DOUBLE * found GROUP BY family),
o AS (SELECT id, kind, start, stop FROM spans WHERE kind < 3
      UNION ALL SELECT id, kind, start, stop FROM l JOIN t USING (family) WHERE level >= least_level),
j AS (SELECT id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
             string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
             string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM o GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (id)"""


@query("op12_secret_scans", _secrets_sql())
def secret_scans(spark, sf_dir):
    found = randomness.scan_secrets(read(spark, sf_dir, "documents"), scratch_dir(spark, "secrets"))

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.sha2(randomness.written(base), 256).alias("base_sha256"), randomness.written(F.col("spans")).alias("spans"))


# ---------------------------------------------------------------- 13: ranked search

_RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT row, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS row, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT id, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS long FROM n),
m AS (SELECT id, doc_id, 100 - 75 + ((75 * n * docs) // long) AS m FROM n, a),
t AS (SELECT id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
s AS (SELECT i.row, i.item_id, m.doc_id, m.id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) <= 10
"""


@query("op13_ranked_search", _RANKED_SQL)
def ranked_search(spark, sf_dir):
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), scratch_dir(spark, "ranked"))
