"""Text, address and date checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.registry import check, ints, scaled
from rankspark.functions import address, calendar, features, text
from rankspark.operators import similarity, skew
from rankspark.session import kept, materialise, scratch
from rankspark.sources import tables

# Pieces of SQL used by several checks.
FULL = "".join(chr(c) for c in range(0xFF00, 0xFF5F)) + "　"
HALF = ("".join(chr(c - 0xFEE0) for c in range(0xFF00, 0xFF5F)) + " ").replace("'", "''")


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[_-]+', ' ', 'g'), '[\\t\\n\\x0b\\f\\r ]{{2,}}', ' ', 'g'), ' ')"


def sql_normalise(c: str) -> str:
    return sql_collapse(f"lower(translate(translate({c}, '{FULL}', '{HALF}'), '萬', '万'))")


def _docs(spark, d):
    return tables.texts(spark, d)


# Whole texts with ASCII widened, so that folding has something to do.
def _wide(c):
    return F.translate(c, text.HALF_WIDTH[1:-1], text.FULL_WIDTH[1:-1])


SQL_WIDE = f"translate(text, '{HALF[1:-1]}', '{FULL[1:-1]}')"


@check("normalize_text", "texts", f"SELECT doc_id, {sql_normalise('text')} AS norm FROM texts")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", text.normalise(F.col("text")).alias("norm"))


@check("fold_width", "texts", f"SELECT doc_id, translate({SQL_WIDE}, '{FULL}', '{HALF}') AS folded FROM texts")
def fold_width(spark, d):
    return _docs(spark, d).select("doc_id", text.fold_width(_wide(F.col("text"))).alias("folded"))


@check("map_chars", "texts", "SELECT doc_id, replace(replace(text, 'e', '萬'), '萬', '万') AS mapped FROM texts")
def map_chars(spark, d):
    traditional = F.translate("text", "e", "萬")
    return _docs(spark, d).select(
        "doc_id", text.map_chars(traditional, text.TRADITIONAL_TO_SIMPLIFIED).alias("mapped")
    )


@check("fold_accents", "texts", "SELECT doc_id, replace(text, 'á', 'a') AS folded FROM texts")
def fold_accents(spark, d):
    return _docs(spark, d).select("doc_id", text.fold_accents(F.col("text")).alias("folded"))


@check("split_words", "texts", """
SELECT doc_id, len(w) AS n_words, array_to_string(w, '¦') AS words
FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+|[0-9]+|(?s:.))', 1) AS w FROM texts)""")
def split_words(spark, d):
    w = text.split_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).alias("n_words"), F.array_join(w, "¦").alias("words"))


@check("collapse_symbols", "texts", f"SELECT doc_id, {sql_collapse('text')} AS collapsed FROM texts")
def collapse_symbols(spark, d):
    return _docs(spark, d).select("doc_id", text.collapse_symbols(F.col("text")).alias("collapsed"))


SQL_WORDS = "list_filter(regexp_split_to_array(address, '\\s+'), lambda x: x <> '')"
SQL_W = f"w AS (SELECT address, {SQL_WORDS} AS w FROM addresses)"


def _address_words(spark, d):
    return tables.addresses(spark, d).withColumn("w", text.words_of(F.col("address")))


@check("dedup_symbols", "addresses", f"""
WITH {SQL_W}
SELECT address, array_to_string([w[i] for i in range(1, len(w) + 1)
  if not coalesce(w[i] IN ('-', '#') AND i > 1 AND w[i] = w[i - 1], false)], ' ') AS cleaned FROM w""")
def dedup_symbols(spark, d):
    w = address.drop_repeated_symbols(F.col("w"))
    return _address_words(spark, d).select("address", F.array_join(w, " ").alias("cleaned"))


@check("number_symbol", "addresses", f"""
WITH {SQL_W}
SELECT address, array_to_string([CASE WHEN w[i] IN ('n', 'no', 'numero') AND i < len(w)
  AND regexp_full_match(w[i + 1], '[0-9]*') THEN '#' ELSE w[i] END for i in range(1, len(w) + 1)], ' ') AS cleaned FROM w""")
def number_symbol(spark, d):
    w = address.number_symbol(F.col("w"))
    return _address_words(spark, d).select("address", F.array_join(w, " ").alias("cleaned"))


@check("omit_affixes", "addresses", f"""
WITH {SQL_W}, s AS (SELECT address, w, CASE WHEN len(w) >= 2 AND w[-1] = 'sur' AND regexp_full_match(w[-2], '[0-9]*')
  THEN w[1:len(w) - 1] ELSE w END AS s FROM w)
SELECT address, array_to_string(CASE WHEN len(w) >= 2 AND w[1] = 'av' AND list_contains(w, 'calle')
  THEN s[2:] ELSE s END, ' ') AS cleaned FROM s""")
def omit_affixes(spark, d):
    w = address.drop_affixes(F.col("w"))
    return _address_words(spark, d).select("address", F.array_join(w, " ").alias("cleaned"))


@check("glue_tokens", "addresses", f"""
WITH {SQL_W}
SELECT address, array_to_string([CASE WHEN i = 1 THEN w[i]
  WHEN regexp_full_match(w[i], '[A-Za-z]') AND regexp_full_match(w[i - 1], '[0-9]*') THEN w[i]
  WHEN regexp_full_match(w[i], '[0-9]*') AND w[i - 1] IN ('#', '-') THEN w[i]
  WHEN w[i] = '-' AND regexp_full_match(w[i - 1], '[0-9]*|[A-Za-z]') THEN w[i]
  ELSE ' ' || w[i] END for i in range(1, len(w) + 1)], '') AS cleaned FROM w""")
def glue_tokens(spark, d):
    return _address_words(spark, d).select("address", address.glue_tokens(F.col("w")).alias("cleaned"))


@check("char_classes", "texts", """
SELECT class, count(*) AS n, count(DISTINCT ch) AS n_chars FROM (
  SELECT ch, CASE WHEN ch >= chr(19968) AND ch <= chr(40869) THEN 'chinese'
    WHEN ch >= '0' AND ch <= '9' THEN 'number'
    WHEN (ch >= 'A' AND ch <= 'Z') OR (ch >= 'a' AND ch <= 'z') THEN 'letter' ELSE 'other' END AS class
  FROM (SELECT unnest(regexp_extract_all(text, '(?s:.)')) AS ch FROM texts)) GROUP BY class""")
def char_classes(spark, d):
    ch = F.explode(F.regexp_extract_all("text", F.lit("((?s:.))"), F.lit(1))).alias("ch")
    per_char = _docs(spark, d).select(ch).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return per_char.groupBy(text.char_class(F.col("ch")).alias("class")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_chars")
    )


SQL_PROSE_WORDS = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@check("stop_words", "texts", f"""
SELECT doc_id, len(k) AS n_kept, array_to_string(k, ' ') AS kept FROM (
  SELECT doc_id, list_filter({SQL_PROSE_WORDS}, lambda x: x NOT IN ('de', 'do', 'da', 'dos', 'das')) AS k FROM texts)""")
def stop_words(spark, d):
    kept = text.remove_stop_words(text.words_of(F.lower("text")))
    return _docs(spark, d).select("doc_id", F.size(kept).alias("n_kept"), F.array_join(kept, " ").alias("kept"))


SQL_SPELLED = "replace(replace(replace(replace(address, 'calle', 'cinco'), 'carrera', 'iii'), 'centro', 'vinte e um'), 'diagonal', 'vinte e dois')"


@check("number_words", "addresses", f"""
WITH s AS (SELECT address, {SQL_SPELLED} AS t FROM addresses)
SELECT address, array_to_string([CASE x WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'iv' THEN '4'
    WHEN 'cinco' THEN '5' WHEN 'tres' THEN '3' ELSE x END for x in string_split(t, ' ')], ' ') AS words,
  replace(replace(t, 'vinte e dois', '22'), 'vinte e um', '21') AS phrases FROM s""")
def number_words(spark, d):
    spelled = F.col("address")
    for street, number in (("calle", "cinco"), ("carrera", "iii"), ("centro", "vinte e um"), ("diagonal", "vinte e dois")):
        spelled = F.replace(spelled, F.lit(street), F.lit(number))
    return tables.addresses(spark, d).withColumn("t", spelled).select(
        "address",
        F.array_join(text.number_words(text.words_of(F.col("t"))), " ").alias("words"),
        text.number_phrases(F.col("t")).alias("phrases"),
    )


@check("compose_keys", "searchers", """
SELECT uid, CAST(city_id AS STRING) || '||' || uid_text AS key, CAST(lat AS STRING) || ',' || CAST(lng AS STRING) AS loc
FROM searchers""")
def compose_keys(spark, d):
    return tables.searchers(spark, d).select(
        "uid",
        text.compose_key(F.col("city_id").cast("string"), "uid_text").alias("key"),
        text.location(F.col("lat"), F.col("lng")).alias("loc"),
    )


@check("char_trigrams", "texts", """
SELECT doc_id, count(*) AS n, count(DISTINCT g) AS n_distinct, min(g) AS first_gram, max(g) AS last_gram FROM (
  SELECT doc_id, unnest(CASE WHEN length(t) < 3 THEN [t]
    ELSE [substring(t, i, 3) for i in range(1, length(t) - 1)] END) AS g
  FROM (SELECT doc_id, lower(text) AS t FROM texts)) WHERE g <> '' GROUP BY doc_id""")
def char_trigrams(spark, d):
    # Texts of one row are summed up there; those that share an id are taken apart and counted together.
    single, several = skew.split_repeated(_docs(spark, d).select("doc_id", "text"), "doc_id")
    grams = text.char_trigrams(F.col("text"))
    sums = lambda g, u: F.struct(
        F.size(g).cast("bigint").alias("n"), F.size(u).cast("bigint").alias("n_distinct"), F.array_min(u).alias("first_gram"), F.array_max(u).alias("last_gram"))
    own = features.let(grams, lambda g: features.let(F.array_distinct(g), lambda u: sums(g, u)))
    out = single.select("doc_id", own.alias("own")).where("own.n > 0").select("doc_id", "own.*")
    if several is None:
        return out
    per_gram = several.select("doc_id", F.explode(grams).alias("g")).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(per_gram.groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.min("g").alias("first_gram"), F.max("g").alias("last_gram"),
    ))


@check("token_overlap", "impressions", """
SELECT impression_id, least(n, 20) AS n_match, round(n / nq, 6) AS match_ratio FROM (
  SELECT impression_id, len(list_intersect(list_distinct(string_split(query, ' ')),
      string_split(replace(name_address, '|', ' '), ' '))) AS n,
    len(list_distinct(string_split(query, ' '))) AS nq FROM impressions)""")
def token_overlap(spark, d):
    n, ratio = text.token_overlap(F.col("query"), F.col("name_address"))
    return tables.impressions(spark, d).select(
        "impression_id", n.alias("n_match"), F.round(ratio, 6).alias("match_ratio")
    )


@check("edit_similarity", "impressions", """
WITH s AS (SELECT impression_id, query, string_split(name_address, '|')[1] AS nm, string_split(name_address, '|')[2] AS ad FROM impressions)
SELECT impression_id, round(1 - levenshtein(query, nm) / greatest(length(query), length(nm)), 6) AS sim_name,
  round(1 - levenshtein(query, ad) / greatest(length(query), length(ad)), 6) AS sim_addr FROM s""")
def edit_similarity(spark, d):
    parts = F.split("name_address", r"\|")
    sim = lambda i: F.round(text.edit_similarity(F.col("query"), F.get(parts, i)), 6)
    return tables.impressions(spark, d).select(
        "impression_id", sim(0).alias("sim_name"), sim(1).alias("sim_addr")
    )


SQL_TERM_WEIGHTS = f"""
w AS (SELECT doc_id, {SQL_PROSE_WORDS} AS w FROM texts),
g AS (SELECT doc_id, 1 AS gram, unnest(w) AS term FROM w
  UNION ALL SELECT doc_id, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w),
tf AS (SELECT doc_id, gram, term, count(*) AS tf FROM g GROUP BY ALL),
idf AS (SELECT gram, term, ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY ALL)"""


@check("tfidf_terms", "texts", f"""
WITH {SQL_TERM_WEIGHTS}
SELECT doc_id, gram, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words, round(sum(tf * idf), 4) AS total_weight,
  round(max(tf * idf), 6) AS max_weight FROM tf JOIN idf USING (gram, term) GROUP BY doc_id, gram""")
def tfidf_terms(spark, d):
    docs = tables.texts(spark, d)
    words = text.words_of(F.lower("text"))
    parts = []
    for n, terms in ((1, words), (2, text.word_bigrams(words))):
        # The counts of one kind of term go before those of the next are made.
        with scratch(spark):
            totals = similarity.tfidf(docs, "doc_id", terms).groupBy("doc_id", F.lit(n).alias("gram")).agg(
                F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_words"),
                F.round(F.sum("weight"), 4).alias("total_weight"), F.round(F.max("weight"), 6).alias("max_weight"),
            )
            with kept():
                parts.append(materialise(totals, "totals"))
    return parts[0].unionByName(parts[1])


# Term tables of every distinct text, for queries, item names and addresses.
SQL_SIM = """
p AS (SELECT impression_id, query, string_split(name_address, '|')[1] AS nm, string_split(name_address, '|')[2] AS ad FROM impressions),
corpus AS (SELECT 'q' AS f, query AS t FROM (SELECT DISTINCT query FROM p)
  UNION ALL SELECT 'n', name FROM places UNION ALL SELECT 'a', addr FROM places),
cw AS (SELECT f, t, string_split(t, ' ') AS w FROM corpus),
grams AS (SELECT f, 1 AS g, t, w AS x FROM cw
  UNION ALL SELECT f, 2, t, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] FROM cw),
df AS (SELECT f, g, term, count(*) AS df FROM (SELECT f, g, unnest(list_distinct(x)) AS term FROM grams) GROUP BY ALL),
n AS (SELECT f, count(*) AS n, avg(len(w)) AS mean_len FROM cw GROUP BY f),
tf AS (SELECT f, g, t, term, count(*) AS tf FROM (SELECT f, g, t, unnest(x) AS term FROM (SELECT DISTINCT f, g, t, x FROM grams)) GROUP BY ALL),
v AS (SELECT tf.f, tf.g, tf.t, tf.term, tf.tf, ln((n.n + 1) / (df.df + 1)) + 1 AS idf, tf.tf * (ln((n.n + 1) / (df.df + 1)) + 1) AS w
  FROM tf JOIN df ON tf.f = df.f AND tf.g = df.g AND tf.term = df.term JOIN n ON tf.f = n.f),
tot AS (SELECT f, g, t, sum(w) AS w, sum(w * w) AS ww, count(*) AS k, sum(tf) AS len FROM v GROUP BY ALL)"""


def _pairs(spark, d):
    """The texts of each impression, written once, and the corpora of queries, names and addresses."""
    parts = F.split("name_address", r"\|")
    rows = materialise(tables.impressions(spark, d).select(
        "impression_id", "query", F.get(parts, 0).alias("name"), F.get(parts, 1).alias("addr")), "texts")
    places = tables.places(spark, d)
    return rows, rows.select(F.col("query").alias("text")).distinct(), places.select(F.col("name").alias("text")), places.select(F.col("addr").alias("text"))


@check("bm25", "impressions places", f"""
WITH {SQL_SIM},
s AS (SELECT q.t AS query, d.f, d.t, sum(d.idf * d.tf * 2.2 / (d.tf + 1.2 * (1 - 0.75 + 0.75 * tot.len / n.mean_len))) AS s
  FROM v q JOIN v d ON q.f = 'q' AND q.g = 1 AND d.f <> 'q' AND d.g = 1 AND q.term = d.term
  JOIN tot ON tot.f = d.f AND tot.g = 1 AND tot.t = d.t JOIN n ON n.f = d.f GROUP BY ALL)
SELECT impression_id, round(coalesce(a.s, 0), 6) AS bm25_name, round(coalesce(b.s, 0), 6) AS bm25_addr
FROM p LEFT JOIN s a ON a.query = p.query AND a.f = 'n' AND a.t = p.nm
LEFT JOIN s b ON b.query = p.query AND b.f = 'a' AND b.t = p.ad""")
def bm25(spark, d):
    rows, queries, names, addrs = _pairs(spark, d)
    one = similarity.unigrams

    def scored(texts):
        r = similarity.attach_vectors(texts, "query", similarity.text_vectors(queries, q=one))
        r = similarity.attach_vectors(r, "name", similarity.text_vectors(names, n=one))
        r = similarity.attach_vectors(r, "addr", similarity.text_vectors(addrs, a=one))
        score = lambda c, corpus: F.round(similarity.bm25(F.col("q"), F.col(c), similarity.mean_length(corpus, one)), 6)
        return r.select("query", "name", "addr", score("n", names).alias("bm25_name"), score("a", addrs).alias("bm25_addr"))

    return similarity.per_texts(rows, ["query", "name", "addr"], scored).select("impression_id", "bm25_name", "bm25_addr")


@check("tfidf_cosine", "impressions places", f"""
WITH {SQL_SIM},
s AS (SELECT q.g, q.t AS query, d.t, sum(q.w * d.w) AS qd, sum(q.w) AS mw, count(*) AS mc, max(q.w) AS mq, max(d.w) AS md
  FROM v q JOIN v d ON q.f = 'q' AND d.f = 'n' AND q.g = d.g AND q.term = d.term GROUP BY ALL)
SELECT impression_id, tq.g AS gram, round(coalesce(s.qd / sqrt(tq.ww * td.ww), 0), 6) AS cosine, round(coalesce(s.mw, 0), 6) AS match_weight,
  round(coalesce(s.mc / tq.k, 0), 6) AS match_count_ratio, round(coalesce(s.mw / tq.w, 0), 6) AS match_weight_ratio,
  round(coalesce(s.mq, 0), 6) AS query_max_weight, round(coalesce(s.md, 0), 6) AS item_max_weight
FROM p JOIN tot tq ON tq.f = 'q' AND tq.t = p.query LEFT JOIN tot td ON td.f = 'n' AND td.t = p.nm AND td.g = tq.g
LEFT JOIN s ON s.g = tq.g AND s.query = p.query AND s.t = p.nm""")
def tfidf_cosine(spark, d):
    rows, queries, names, _ = _pairs(spark, d)

    def of_gram(n: int):
        found = similarity.cosine_features(F.col(f"q{n}"), F.col(f"n{n}"))
        return features.let(found, lambda v: F.struct(F.lit(n).alias("gram"), *[F.round(F.get(v, i), 6).alias(k) for i, k in enumerate(similarity.COSINE)]))

    def scored(texts):
        for column, corpus in (("query", queries), ("name", names)):
            kinds = {f"{column[0]}1": similarity.unigrams, f"{column[0]}2": similarity.bigrams}
            texts = similarity.attach_vectors(texts, column, similarity.text_vectors(corpus, **kinds))
        return texts.select("query", "name", F.array(of_gram(1), of_gram(2)).alias("grams"))

    return similarity.per_texts(rows, ["query", "name"], scored).select("impression_id", F.inline("grams"))


def _slots_sql() -> str:
    """All 23 similarity slots of a row, as whole multiples of 10^-4."""
    cosine = {
        "cosine": "s.qd / sqrt(tq.ww * td.ww)", "match_weight": "s.mw", "match_count_ratio": "s.mc / tq.k",
        "match_weight_ratio": "s.mw / tq.w", "query_max_weight": "s.mq", "item_max_weight": "s.md"}
    of_gram = lambda g: f"""
c{g} AS (SELECT impression_id, {', '.join(f'coalesce({cosine[k]}, 0) AS {k}' for k in similarity.COSINE)}
  FROM p LEFT JOIN tot tq ON tq.f = 'q' AND tq.g = {g} AND tq.t = p.query LEFT JOIN tot td ON td.f = 'n' AND td.g = {g} AND td.t = p.nm
  LEFT JOIN s ON s.g = {g} AND s.query = p.query AND s.t = p.nm)"""
    slots = ["1"] + [f"c{g}.{k}" for g in (1, 2) for k in similarity.COSINE] + ["coalesce(a.s, 0)", "coalesce(b.s, 0)"]
    slots += [f"1 - levenshtein(query, {c}) / greatest(length(query), length({c}))".replace("query", "p.query") for c in ("nm", "ad")]
    slots += [f"len(string_split({c}, ' '))" for c in ("p.query", "nm", "ad")] + [f"length({c})" for c in ("p.query", "nm", "ad")]
    shown = ", ".join(f"CAST(round(({x}) * 10000) AS BIGINT)" for x in slots)
    return f"""
WITH {SQL_SIM},
s AS (SELECT q.g, q.t AS query, d.t, sum(q.w * d.w) AS qd, sum(q.w) AS mw, count(*) AS mc, max(q.w) AS mq, max(d.w) AS md
  FROM v q JOIN v d ON q.f = 'q' AND d.f = 'n' AND q.g = d.g AND q.term = d.term GROUP BY ALL),{of_gram(1)},{of_gram(2)},
bm AS (SELECT q.t AS query, d.f, d.t, sum(d.idf * d.tf * 2.2 / (d.tf + 1.2 * (1 - 0.75 + 0.75 * tot.len / n.mean_len))) AS s
  FROM v q JOIN v d ON q.f = 'q' AND q.g = 1 AND d.f <> 'q' AND d.g = 1 AND q.term = d.term
  JOIN tot ON tot.f = d.f AND tot.g = 1 AND tot.t = d.t JOIN n ON n.f = d.f GROUP BY ALL)
SELECT p.impression_id, concat_ws(',', {shown}) AS slots
FROM p JOIN c1 ON c1.impression_id = p.impression_id JOIN c2 ON c2.impression_id = p.impression_id
LEFT JOIN bm a ON a.query = p.query AND a.f = 'n' AND a.t = p.nm LEFT JOIN bm b ON b.query = p.query AND b.f = 'a' AND b.t = p.ad"""


@check("similarity_slots", "impressions places", _slots_sql())
def similarity_slots(spark, d):
    r = similarity.similarity_features(*_pairs(spark, d))
    return r.select("impression_id", scaled("sim").alias("slots"))


@check("text_lengths", "impressions", """
WITH s AS (SELECT impression_id, query, string_split(name_address, '|')[1] AS nm, string_split(name_address, '|')[2] AS ad FROM impressions)
SELECT impression_id, len(string_split(query, ' ')) AS q_terms, len(string_split(nm, ' ')) AS n_terms,
  len(string_split(ad, ' ')) AS a_terms, length(query) AS q_len, length(nm) AS n_len, length(ad) AS a_len FROM s""")
def text_lengths(spark, d):
    parts = F.split("name_address", r"\|")
    cols = {"q": F.col("query"), "n": F.get(parts, 0), "a": F.get(parts, 1)}
    return tables.impressions(spark, d).select(
        "impression_id",
        *[F.size(F.split(c, " ")).alias(f"{k}_terms") for k, c in cols.items()],
        *[F.length(c).alias(f"{k}_len") for k, c in cols.items()],
    )


@check("list_codec", "vectors", """
SELECT vec_id, len(embedding) AS n,
  array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS STRING)), ',') AS micros
FROM vectors""")
def list_codec(spark, d):
    v = tables.vectors(spark, d).withColumn("line", text.list_text(F.col("embedding")))
    back = v.withColumn("back", text.parse_list(F.col("line")))
    micros = F.transform("back", lambda x: F.round(x * 1_000_000).cast("bigint"))
    return back.select("vec_id", F.size("back").alias("n"), ints(micros).alias("micros"))


# ---------------------------------------------------------------- dates


@check("days_between", "", """
SELECT o_orderkey, len(days) AS n, days[1] AS first_day, days[-1] AS last_day FROM (
  SELECT o_orderkey, [strftime(x, '%Y%m%d') for x in generate_series(
    CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 40) DAY, INTERVAL 1 DAY)] AS days
  FROM orders)""")
def days_between(spark, d):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, F.pmod("o_orderkey", F.lit(40)).cast("int"))
    days = tables.table(spark, d, "orders").select("o_orderkey", calendar.days_between(start, end).alias("days"))
    return days.select(
        "o_orderkey", F.size("days").alias("n"),
        F.element_at("days", 1).alias("first_day"), F.element_at("days", -1).alias("last_day"),
    )


@check("days_before", "", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 DAY, '%Y%m%d') AS week_before,
  strftime(o_orderdate - INTERVAL 62 DAY, '%Y%m%d') AS window_start FROM orders""")
def days_before(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return tables.table(spark, d, "orders").select(
        "o_orderkey", calendar.days_before(day, 7).alias("week_before"),
        calendar.days_before(day, 62).alias("window_start"),
    )


@check("hour_bucket", "", """
SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 0 WHEN hour(ts) BETWEEN 12 AND 17 THEN 1 ELSE 2 END AS bucket
FROM events""")
def hour_bucket(spark, d):
    line = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return tables.table(spark, d, "events").select(
        "event_id", calendar.hour_bucket(calendar.hour_of(line)).alias("bucket")
    )


@check("calendar_buckets", "", """
SELECT event_id, dayofweek(ts) + 1 AS week_bucket, CAST(floor(hour(ts) / 4) AS INT) AS day_bucket FROM events""")
def calendar_buckets(spark, d):
    return tables.table(spark, d, "events").select(
        "event_id", calendar.week_bucket(F.col("ts")).alias("week_bucket"),
        calendar.day_bucket(F.hour("ts")).alias("day_bucket"),
    )
