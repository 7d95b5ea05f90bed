"""Text and retrieval queries: documents stand for chunks, benchmark items for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from belltower.functions import speech
from belltower.functions import text as T
from belltower.functions.chunking import chunk_column
from belltower.operators import lexical as L
from belltower.operators import impacts, vectors
from belltower.operators.directory import named_centres
from belltower.operators.reporting import sections
from belltower.operators.sequences import carried_subject
from belltower.sources.stored import made_once, signature
from belltower.sources.tables import bounded_batches, table

STOP = ("a", "an", "and", "are", "is", "of", "on", "the", "to", "with")
SUBJECT = ("that", "this", "onth", "ing")
SYNONYMS = (("that", "this"), ("onth", "ones"), ("inst", "erth"))
MARKERS, ALIASES = ("th",), ("of the",)
#: Queries are the rows whose id is divisible by this, against all rows.
QUESTIONS = 20


def terms(c: F.Column) -> F.Column:
    return T.content_terms(c, STOP, F.lower)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The words of the query items, and their first one misspelt."""
    q = table(spark, d, "benchmark").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("t"))
    q = q.withColumn("t", F.concat("t", F.array(F.concat(F.element_at("t", 1), F.lit("qx")))))
    return q.select("query_id", F.explode("t").alias("term")).distinct()


def intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("query_id"), "text")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for g in SYNONYMS for a in g for b in g if a != b], "term string, synonym string")


def index(spark: SparkSession, d: str) -> L.Index:
    """The index of all documents: built and stored by the first query that asks for it, read back by the others as long as the files are the same."""
    docs = table(spark, d, "documents")
    return made_once(spark, f"{signature(docs)} {STOP}", lambda: L.Index(docs.select(F.col("doc_id").alias("chunk_id"), "text"), F.split(F.lower("text"), T.BETWEEN_WORDS), STOP, T.canonical_word))


def matched(hits: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """hits (query_id, chunk_id) with how well each chunk's text matches its query's terms, and whether strongly. A vector's id is that of the item or document it stands for."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), T.alias_terms(F.col("text"), STOP, MARKERS, ALIASES, F.lower).alias("terms"))
    c = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), T.search_text(F.col("text"), F.lower).alias("text"))
    both = hits.join(q, "query_id").join(c, "chunk_id")
    return both.withColumn("match", T.match_score(F.col("text"), F.col("terms"))).withColumn("strong", T.strong_match(F.col("text"), F.col("terms"))).drop("text", "terms")


def both_channels(s: SparkSession, d: str) -> DataFrame:
    v = vectors.self_top_k(table(s, d, "embeddings"), QUESTIONS, 16).select("query_id", F.col("vec_id").alias("chunk_id"), "similarity")
    x = L.search(index(s, d), questions(s, d), 4, 0.34, synonyms(s))
    return L.fused(matched(v, s, d), x.select("query_id", "chunk_id", "coverage"), 0.3, 4)


def turns(s: SparkSession, d: str) -> DataFrame:
    """The words of every message, as a query of its own."""
    t = table(s, d, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("query_id"), F.explode(F.split(T.canonical(F.col("text"), F.lower), " ")).alias("w"))
    return t.where((F.length("w") > 1) & ~F.col("w").isin(*STOP)).select("query_id", T.stem(F.col("w")).alias("term")).distinct()


#: What names a subject, up to how many words a message leans on an earlier one, messages of history, and characters of context.
LEANS_ON, LEAN, PAST, ROOM = "nt", 30, 4, 700


def turn_prompts(s: SparkSession, d: str) -> DataFrame:
    """From history to prompt, for every user's message: what it leans on is put before it, the best documents for that are searched and packed into a context, and both stand in the prompt with the messages before."""
    m = table(s, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 10_000 + F.col("turn")).alias("query_id"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-PAST, -1)
    said = F.concat("role", F.lit(": "), "text")
    m = m.withColumn("history", F.array_join(F.collect_list(said).over(before), "\n"))
    subject = F.when(F.contains("text", F.lit(LEANS_ON)), F.lit("subject"))
    asked = carried_subject(m, "conv_id", "turn", subject, F.size(F.split(F.trim("text"), " ")), least_words=LEAN).where("role = 'user'")
    w = asked.select("query_id", F.explode(F.split(T.canonical(F.col("retrieval_query"), F.lower), " ")).alias("w")).where((F.length("w") > 1) & ~F.col("w").isin(*STOP))
    best = impacts.search_many(index(s, d), w.select("query_id", T.stem(F.col("w")).alias("term")), 4, 0.34, synonyms(s))
    # no context has room for more of a text, so no more of it is shuffled
    found = best.join(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.substring("text", 1, ROOM + 1).alias("text")), "chunk_id")
    packed = T.context(found, "query_id", "rank", F.concat(F.lit("[Source: "), F.col("source"), F.lit("]")), F.col("text"), ROOM)
    prompt = sections({"Conversation": F.col("history"), "Context": F.col("context"), "Question": F.col("text")})
    return asked.join(packed, "query_id", "left").select("query_id", prompt.alias("prompt"))


def lexical_candidates(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a word of a query item, those nearest to it first."""
    own = index(s, d).met(questions(s, d), "term").select("query_id", F.col("chunk_id").alias("vec_id")).distinct()
    near = vectors.top_k_among(own, table(s, d, "embeddings"), 50)
    return L.matching_nearest(near.withColumnRenamed("vec_id", "chunk_id"))


def doc_chunks(s: SparkSession, d: str) -> DataFrame:
    bounded_batches(s)
    pages = F.array(F.struct(F.lit(1).alias("page_number"), T.normalized(F.col("text")).alias("text")))
    return table(s, d, "documents").select("doc_id", F.explode(chunk_column(pages)).alias("c")).select("doc_id", "c.*")


def folded_texts(s: SparkSession, d: str) -> DataFrame:
    bounded_batches(s)
    return table(s, d, "documents").select("doc_id", T.search_text(F.col("text")).alias("t"))


def contexts(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "conversations").select("conv_id", "turn", "role", "text").where("text IS NOT NULL")
    return T.context(r, "conv_id", "turn", F.concat(F.lit("[Source: "), F.col("role"), F.lit("]")), F.col("text"), 700)


CENTRES = ((0, "of the and that", "first", ("the and of",)), (1, "and the", "second", ("for with", "is to")), (2, "to", "third", None))


def listed_centres(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(CENTRES), "ordinal int, district string, name string, aliases array<string>")


QUERIES = {
    "centre_match": lambda s, d: named_centres(table(s, d, "documents").select("doc_id", "text"), listed_centres(s), "doc_id"),
    "normalized_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("digest")),
    "search_text": lambda s, d: table(s, d, "benchmark").select("item_id", T.search_text(F.col("text"), F.lower).alias("t")),
    "search_text_nfkc": folded_texts,
    "content_terms": lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(terms(F.col("text")), " ").alias("terms")),
    "trigram_dice": lambda s, d: table(s, d, "part").select("p_partkey", F.round(T.dice(T.trigrams(F.col("p_name")), T.trigrams(F.col("p_type"))), 6).alias("dice")),
    "match_score": lambda s, d: table(s, d, "documents").select("doc_id", F.round(T.match_score(T.search_text(F.col("text"), F.lower), F.array(F.lit("the"), F.lit("las"), F.lit("onqx"), F.lit("of the th"))), 6).alias("score")),
    "directory_form": lambda s, d: table(s, d, "benchmark").select("item_id", T.directory_form(F.col("text")).alias("t")),
    "script_share": lambda s, d: table(s, d, "documents").select("doc_id", F.round(T.script_share(F.col("text"), "a-zA-Z"), 6).alias("share")),
    "scrubbed": lambda s, d: table(s, d, "customer").select("c_custkey", T.scrubbed(F.col("c_name"), ["Customer", "short"]).alias("name")),
    "content_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")),
    "document_chunks": lambda s, d: doc_chunks(s, d).select("doc_id", "chunk_index", "page_number", "text"),
    "contexts": contexts,
    "spoken_text": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", speech.spoken_text("text").alias("spoken"), F.size(speech.speech_chunks("text")).cast("long").alias("parts")),
    "number_words": lambda s, d: table(s, d, "part").select("p_partkey", speech.number_in_words(F.col("p_retailprice").cast("long") * 1234).alias("words")),
    "bm25_statistics": lambda s, d: index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf")),
    "bm25_search": lambda s, d: L.search(index(s, d), questions(s, d), 4, 0.34, synonyms(s)),
    "intent_search": lambda s, d: L.search(index(s, d), questions(s, d), 4, 0.34, synonyms(s), L.asked_for(intents(s, d), "[aeiouAEIOU]th", ("this", "that"))),
    "topic_words": lambda s, d: table(s, d, "benchmark").select("item_id", T.topic_words(F.col("text"), SUBJECT, F.lower).alias("w")).select("item_id", (F.size("w") > 0).alias("named"), F.array_join("w", " ").alias("words")),
    "turn_search": lambda s, d: impacts.search_many(index(s, d), turns(s, d), 4, 0.34, synonyms(s)),
    "turn_prompts": turn_prompts,
    "hybrid_search": both_channels,
    "lexical_candidates": lexical_candidates,
    "query_terms": lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.alias_terms(F.col("text"), STOP, MARKERS, ALIASES, F.lower), ",").alias("terms")),
    "answer_sources": lambda s, d: L.search(index(s, d), questions(s, d), 4, 0.34, synonyms(s)).join(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id").groupBy("query_id", "source").agg(F.min("rank").alias("first")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]), ",").alias("sources")),
    "tts_text": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", speech.tts_text(F.col("text"), {"OK": "ठीक है"}).alias("voiced")).withColumn("unspoken", F.array_join(speech.unspoken_latin(F.col("voiced")), " ")),
}
FORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TERMS = "list_filter(string_split(translate(replace(replace({0}, '़', ''), 'ँ', 'ं'), 'ीूईऊॉऑ०१२३४५६७८९', 'िुइउाआ0123456789'), ' '), lambda w : len(w) > 1 AND w NOT IN ('" + "','".join(STOP) + "'))"


def _terms(c: str) -> str:
    return TERMS.format(FORM.format(c))


QUERY_TERMS = f"SELECT item_id, list_filter(w, lambda x, i : len(x) > 1 AND x NOT IN ('" + "','".join(STOP) + f"') AND list_position(w, x) = i) AS own, contains(f, 'th') AS marked FROM (SELECT item_id, f, string_split(f, ' ') AS w FROM (SELECT item_id, {FORM.format('text')} AS f FROM benchmark))"
BM25 = f"""t AS (SELECT doc_id AS chunk_id, {_terms('text')} AS t FROM documents), tot AS (SELECT count(*) AS chunks, avg(len(t)) AS average FROM t),
po AS (SELECT chunk_id, n, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
te AS (SELECT term, df, ln(1 + (chunks - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY 1), tot),
qt AS (SELECT item_id AS query_id, {_terms('text')} AS t FROM benchmark WHERE item_id % {QUESTIONS} = 0), q AS (SELECT DISTINCT query_id, unnest(list_append(t, t[1] || 'qx')) AS term FROM qt),
sy(term, synonym) AS (VALUES {', '.join(f"('{a}','{b}')" for g in SYNONYMS for a in g for b in g if a != b)}),
ex AS (SELECT query_id, q.term, te.term AS variant, 1.0::DOUBLE AS weight, idf FROM q JOIN te USING (term) UNION ALL SELECT query_id, q.term, te.term, 0.8, idf FROM q JOIN sy ON sy.term = q.term JOIN te ON te.term = sy.synonym),
lost AS (SELECT * FROM q WHERE len(term) >= 3 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = q.query_id AND ex.term = q.term)),
ga AS (SELECT DISTINCT term, unnest(list_transform(range(1, len(term) + 1), lambda i : substr('#' || term || '#', i, 3))) AS g FROM lost), gb AS (SELECT DISTINCT term AS variant, unnest(list_transform(range(1, len(term) + 1), lambda i : substr('#' || term || '#', i, 3))) AS g FROM te),
di AS (SELECT ga.term, variant, 2.0 * count(*) / ((SELECT count(*) FROM ga x WHERE x.term = ga.term) + (SELECT count(*) FROM gb y WHERE y.variant = gb.variant)) AS dice FROM ga JOIN gb USING (g) WHERE abs(len(ga.term) - len(variant)) <= 3 GROUP BY ga.term, gb.variant),
e AS (SELECT * FROM ex UNION ALL SELECT query_id, lost.term, variant, 0.5 * dice, idf FROM lost JOIN di USING (term) JOIN te ON te.term = variant WHERE dice >= 0.55),
ba AS (SELECT query_id, term, max(idf) AS base FROM e GROUP BY ALL), un AS (SELECT query_id, 0.6 * avg(base) AS unseen FROM ba GROUP BY 1),
ev AS (SELECT q.query_id, q.term, coalesce(base, unseen) AS base FROM q JOIN un USING (query_id) LEFT JOIN ba ON ba.query_id = q.query_id AND ba.term = q.term), wh AS (SELECT query_id, sum(base) AS whole FROM ev GROUP BY 1),
pt AS (SELECT query_id, chunk_id, e.term, sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))) AS s, max(weight) AS w FROM e JOIN po ON po.term = variant, tot GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(s), 6) AS score, round(least(sum(base * w) / any_value(whole), 1.0), 6) AS coverage FROM pt JOIN ev USING (query_id, term) JOIN wh USING (query_id) GROUP BY ALL),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM sc WHERE coverage >= 0.34) WHERE rank <= 4)"""
#: The same for the words of every message.
TURNS = BM25.replace(f"qt AS (SELECT item_id AS query_id, {_terms('text')} AS t FROM benchmark WHERE item_id % {QUESTIONS} = 0), q AS (SELECT DISTINCT query_id, unnest(list_append(t, t[1] || 'qx')) AS term FROM qt)", f"q AS (SELECT DISTINCT conv_id * 10000 + turn AS query_id, unnest({_terms('text')}) AS term FROM conversations)")
ASKED = f"""m AS (SELECT conv_id, turn, role, text, conv_id * 10000 + turn AS query_id, CASE WHEN contains(text, '{LEANS_ON}') THEN 'subject' END AS s, len(string_split(trim(text), ' ')) AS w FROM conversations),
er AS (SELECT *, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {PAST} PRECEDING AND 1 PRECEDING) AS history, coalesce(last_value(s IGNORE NULLS) OVER p, last_value(CASE WHEN w > {LEAN} THEN text END IGNORE NULLS) OVER p, last_value(text IGNORE NULLS) OVER p) AS earlier FROM m WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
asked AS (SELECT *, CASE WHEN s IS NOT NULL OR w > {LEAN} OR earlier IS NULL THEN text ELSE earlier || ' ' || text END AS rq FROM er WHERE role = 'user')"""
PROMPTS = f"{ASKED}, " + TURNS.replace(f"q AS (SELECT DISTINCT conv_id * 10000 + turn AS query_id, unnest({_terms('text')}) AS term FROM conversations)", f"q AS (SELECT DISTINCT query_id, unnest({_terms('rq')}) AS term FROM asked)")
def _said(v: str, more: int) -> str:
    """SQL for a number that isn't negative in words."""
    word = lambda x: f"string_split('{' '.join(speech.NUMBERS)}', ' ')[({x}) + 1]"
    parts, held = [], 100
    for holds, name in speech.PLACES:
        d = f"(({v}) // {held}) % {holds}"
        parts.append(f"CASE WHEN {d} > 0 THEN {word(d)} || ' {name}' END")
        held *= holds
    beyond = [f"CASE WHEN ({v}) // {held} > 0 THEN {_said(f'({v}) // {held}', more - 1)} || ' {speech.BEYOND}' END"] if more else []
    return f"concat_ws(' ', {', '.join([*beyond, *parts[::-1], f'CASE WHEN ({v}) % 100 > 0 OR ({v}) = 0 THEN {word(f"({v}) % 100")} END'])})"


NAMES = ", ".join(f"({o}, '{n}', '{x}')" for o, x0, n, more in CENTRES for x in (x0, *(more or ())))
ORACLE_SQL = {
    "centre_match": rf"""WITH f AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS f FROM documents), h AS (SELECT DISTINCT doc_id, ordinal::INTEGER AS ordinal, name FROM f JOIN (VALUES {NAMES}) v(ordinal, name, x) ON contains(f, ' ' || x || ' '))
SELECT doc_id, min(ordinal) AS ordinal, min_by(name, ordinal) AS name FROM h GROUP BY 1""",
    "normalized_text": r"SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t\x0B\f\r]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E'\n'), lambda x : trim(x)), E'\n'), '^\s+|\s+$', '', 'g')) AS digest FROM documents",
    "number_words": f"SELECT p_partkey, {_said('trunc(p_retailprice)::BIGINT * 1234', 1)} AS words FROM part",
    "search_text": f"SELECT item_id, {FORM.format('text')} AS t FROM benchmark",
    "content_terms": f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM benchmark",
    "trigram_dice": "WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, len(p_name) + 1), lambda i : substr('#' || p_name || '#', i, 3))) AS a, list_distinct(list_transform(range(1, len(p_type) + 1), lambda i : substr('#' || p_type || '#', i, 3))) AS b FROM part) SELECT p_partkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6)::DOUBLE AS dice FROM g",
    "match_score": f"WITH f AS (SELECT doc_id, {FORM.format('text')} AS t FROM documents) SELECT doc_id, round(CASE WHEN t = '' THEN 0 WHEN contains(t, 'of the th') THEN 1 ELSE len(list_intersect(['the', 'las', 'onqx'], string_split(t, ' '))) / 3 END::DOUBLE, 6) AS score FROM f",
    "directory_form": r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM benchmark",
    "script_share": r"SELECT doc_id, round(len(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(len(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')), 0), 6)::DOUBLE AS share FROM documents",
    "scrubbed": "SELECT c_custkey, replace(c_name, 'Customer', '[REDACTED]') AS name FROM customer",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "contexts": r"""WITH e AS (SELECT conv_id, turn, '[Source: ' || role || ']' || chr(10) || text AS e FROM conversations WHERE text IS NOT NULL), b AS (SELECT *, coalesce(sum(len(e)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e)
SELECT conv_id, nullif(coalesce(string_agg(CASE WHEN before + len(e) <= 700 THEN e WHEN 700 - before > 50 THEN rtrim(e[1:700 - before], ' ') || '...' END, chr(10) || chr(10) ORDER BY turn), ''), '') AS context FROM b WHERE before < 700 GROUP BY conv_id""",
    "bm25_statistics": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM te",
    "bm25_search": f"WITH {BM25} SELECT query_id, chunk_id, score, coverage, rank FROM lx",
    "intent_search": f"""WITH {BM25}, it AS (SELECT item_id AS query_id, unnest(['this', 'that']) AS term FROM benchmark WHERE item_id % {QUESTIONS} = 0 AND regexp_matches(text, '[aeiouAEIOU]th')),
p2 AS (SELECT query_id, chunk_id, s, base * w AS c FROM pt JOIN ev USING (query_id, term) UNION ALL SELECT query_id, chunk_id, 0.5 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average)), 0 FROM it JOIN te USING (term) JOIN po USING (term), tot),
s2 AS (SELECT query_id, chunk_id, round(sum(s), 6) AS score, round(least(sum(c) / any_value(whole), 1.0), 6) AS coverage FROM p2 JOIN wh USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, coverage, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s2 WHERE coverage >= 0.34) WHERE rank <= 4""",
    "turn_prompts": f"""WITH {PROMPTS}, en AS (SELECT query_id, rank, '[Source: ' || source || ']' || chr(10) || text AS e FROM lx JOIN documents ON doc_id = chunk_id), be AS (SELECT *, coalesce(sum(len(e)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM en),
cx AS (SELECT query_id, string_agg(CASE WHEN before + len(e) <= {ROOM} THEN e WHEN {ROOM} - before > 50 THEN rtrim(e[1:{ROOM} - before], ' ') || '...' END, chr(10) || chr(10) ORDER BY rank) AS context FROM be WHERE before < {ROOM} GROUP BY 1)
SELECT query_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(history) <> '' THEN 'Conversation:' || chr(10) || trim(history) END, CASE WHEN trim(context) <> '' THEN 'Context:' || chr(10) || trim(context) END, CASE WHEN trim(text) <> '' THEN 'Question:' || chr(10) || trim(text) END) AS prompt FROM asked LEFT JOIN cx USING (query_id)""",
    "turn_search": f"WITH {TURNS} SELECT query_id, chunk_id, score, coverage, rank FROM lx",
    "topic_words": r"""WITH w AS (SELECT item_id, row_number() OVER () AS r, string_split_regex(text, '\s+') AS w FROM benchmark), v AS (SELECT item_id, list_filter(list_transform(w, lambda x : trim(x, '?!.,;:।॥''"()[]{}–—…“”‘’-')), lambda x : lower(x) IN ('that', 'this', 'onth', 'ing')) AS v FROM w)
SELECT item_id, len(v) > 0 AS named, array_to_string(v, ' ') AS words FROM v""",
    "query_terms": f"SELECT item_id, array_to_string(list_concat(own, CASE WHEN marked THEN list_filter(['of the', 'of', 'the'], lambda w : NOT list_contains(own, w)) ELSE [] END), ',') AS terms FROM ({QUERY_TERMS})",
    "answer_sources": f"WITH {BM25}, s AS (SELECT query_id, source, min(rank) AS first FROM lx JOIN documents ON doc_id = chunk_id GROUP BY ALL) SELECT query_id, string_agg(source, ',' ORDER BY first, source) AS sources FROM s GROUP BY 1",
    "lexical_candidates": f"""WITH {BM25}, own AS (SELECT DISTINCT query_id, chunk_id FROM q JOIN po USING (term)), s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM own JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM s) WHERE rank <= 50""",
    "hybrid_search": f"""WITH {BM25}, em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM em a, em b WHERE a.vec_id % {QUESTIONS} = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM s) WHERE r <= 16),
qw AS ({QUERY_TERMS}), dw AS (SELECT doc_id AS chunk_id, {FORM.format('text')} AS x FROM documents WHERE doc_id IN (SELECT chunk_id FROM near)),
mt AS (SELECT query_id, chunk_id, similarity, marked AND contains(x, 'of the') AS strong, CASE WHEN marked THEN list_distinct(list_concat(own, ['of', 'the'])) ELSE own END AS single, x FROM near JOIN qw ON item_id = query_id JOIN dw USING (chunk_id)),
k AS (SELECT query_id, chunk_id, similarity, 0.15 * CASE WHEN x = '' OR len(single) = 0 THEN 0 WHEN strong THEN 1 ELSE len(list_intersect(single, string_split(x, ' '))) / len(single) END::DOUBLE AS m FROM mt WHERE similarity >= 0.3 OR strong),
f AS (SELECT query_id, chunk_id, round(CASE WHEN k.similarity IS NULL THEN 0.35 + 0.65 * coverage WHEN coverage IS NULL THEN k.similarity + m ELSE greatest(k.similarity + m, 0.35 + 0.65 * coverage) + 0.05 END, 6) AS score, round(coalesce(k.similarity, 0.35 + 0.65 * coverage), 6) AS similarity FROM k FULL JOIN lx USING (query_id, chunk_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, chunk_id)::INTEGER AS rank FROM f) SELECT query_id, chunk_id, score, similarity, rank FROM z WHERE rank <= 4""",
}
