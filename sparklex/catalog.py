"""Registered queries over the standard tables, with the same answers in DuckDB SQL.

Each entry exercises one operator through the engine's public interface.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import EngineConfig, SearchEngine
from .functions.scoring import Bm25, byte_levenshtein
from .functions.text import Analyzer, english_stop_words, lowercase_filter, standard_tokenizer, whitespace_tokenizer
from .functions.values import decode_int64, encode_int64, infer_type
from .operators import expand, index
from .operators.search import Cursor, SearchOptions, Sort, sort_by
from .plans.mapping import FieldMapping, infer_mapping, inferred_types
from .plans.query import Builder, Query
from .sources import documents
from .sources.change_log import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STOPPED = Analyzer(standard_tokenizer, (english_stop_words,))
_WS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def query(name: str, sql: str | None = None):
    """Register a function as a query, with its oracle."""

    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, **config) -> SearchEngine:
    """An engine over ``documents``: text analysed, lang and source as keywords, n_chars as a number."""
    mapping = {"text": FieldMapping("text"), "lang": FieldMapping("keyword"), "source": FieldMapping("keyword"), "n_chars": FieldMapping("integer")}
    return SearchEngine(spark, EngineConfig(mapping=mapping, **config)).index(_table(spark, sf_dir, "documents"), check_ids=False)


def _texts(spark: SparkSession, sf_dir: str, **config) -> SearchEngine:
    """An engine over the text of ``documents`` alone."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return SearchEngine(spark, EngineConfig(mapping={"text": FieldMapping("text")}, **config)).index(rows, check_ids=False)


def _parts(spark: SparkSession, sf_dir: str, **config) -> SearchEngine:
    mapping = {
        "p_name": FieldMapping("text", boost=2.0),
        "p_type": FieldMapping("text"),
        "p_brand": FieldMapping("keyword"),
        "p_size": FieldMapping("integer"),
        "p_retailprice": FieldMapping("float"),
    }
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice")
    return SearchEngine(spark, EngineConfig(mapping=mapping, **config)).index(rows, "p_partkey", check_ids=False)


def _events(spark: SparkSession, sf_dir: str) -> SearchEngine:
    mapping = {"event_type": FieldMapping("keyword"), "value": FieldMapping("float"), "user_id": FieldMapping("integer"), "props": FieldMapping("keyword")}
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", "props")
    return SearchEngine(spark, EngineConfig(mapping=mapping)).index(rows, "event_id", check_ids=False)


def _vectors(spark: SparkSession, sf_dir: str) -> SearchEngine:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    mapping = {"text": FieldMapping("text"), "embedding": FieldMapping("vector")}
    return SearchEngine(spark, EngineConfig(mapping=mapping)).index(rows.join(vectors, "doc_id", "full_outer"), check_ids=False)


def _scored(hits: DataFrame, name: str = "doc_id") -> DataFrame:
    return hits.select(F.col("doc_id").alias(name), F.round("score", 6).alias("score"))


# -- oracle fragments ------------------------------------------------------


def _tokens(text: str) -> str:
    kept = f"lower(regexp_replace({text}, '[^\\p{{L}}\\p{{P}}{_WS}]', '', 'g'))"
    return f"list_filter(string_split_regex({kept}, '[\\p{{P}}{_WS}]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{_WS}]+'), lambda x: x <> '')"


_STOP = "['" + "','".join(english_stop_words.words) + "']"
_DOC_TOKENS = f"tok AS (SELECT doc_id, {_tokens('text')} AS t FROM documents)"


def _tf(term: str, t: str = "t") -> str:
    return f"len(list_filter({t}, lambda x: x = '{term}'))::double"


def _bm25(term: str, n: str = "(SELECT count(*) FROM tok)", k1: float = 1.2, b: float = 0.75, source: str = "tok", boost: float = 1.0) -> str:
    df = f"(SELECT count(*) FROM {source} WHERE list_contains(t, '{term}'))::double"
    avg = f"(SELECT avg(len(t)) FROM {source})"
    f = _tf(term, f"{source}.t")
    return (
        f"ln(1 + ({n}::double - {df} + 0.5::double) / ({df} + 0.5::double)) * ({f} * {k1 + 1.0}::double) / "
        f"({f} + {k1}::double * ({1 - b}::double + {b}::double * (len({source}.t)::double / {avg}))) * {boost}::double"
    )


def _has(term: str, t: str = "t") -> str:
    return f"list_contains({t}, '{term}')"


def _phrase(terms: list[str], t: str = "t") -> str:
    checks = " AND ".join(f"{t}[i + {k}] = '{w}'" for k, w in enumerate(terms))
    return f"len(list_filter(range(1, len({t}) - {len(terms) - 2}), lambda i: {checks})) > 0"


# -- analysis ----------------------------------------------------------------


def _exploded(df: DataFrame, tokens) -> DataFrame:
    return df.select("doc_id", F.posexplode(tokens).alias("pos", "term")).where(F.col("term").isNotNull())


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").cast("bigint").alias("first_pos"))


def _token_sql(tokens: str, keep: str = "true") -> str:
    return f"""
SELECT doc_id, term, count(*) AS freq, min(pos)::bigint AS first_pos
FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {tokens} AS t FROM documents))
WHERE {keep} GROUP BY ALL"""


@query("tok_standard", _token_sql(_tokens("text")))
def tok_standard(spark, sf_dir):
    return _counted(_exploded(_table(spark, sf_dir, "documents"), standard_tokenizer(F.col("text"))))


@query("tok_whitespace", _token_sql(_words("text")))
def tok_whitespace(spark, sf_dir):
    return _counted(_exploded(_table(spark, sf_dir, "documents"), whitespace_tokenizer(F.col("text"))))


@query("tok_stopwords", _token_sql(_tokens("text"), f"NOT list_contains({_STOP}, term)"))
def tok_stopwords(spark, sf_dir):
    return _counted(_exploded(_table(spark, sf_dir, "documents"), STOPPED(F.col("text"))))


@query("tok_lowercase_filter", _token_sql(_words("lower(text)")))
def tok_lowercase_filter(spark, sf_dir):
    return _counted(_exploded(_table(spark, sf_dir, "documents"), Analyzer(whitespace_tokenizer, (lowercase_filter,))(F.col("text"))))


@query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::bigint AS distance FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey")
def edit_distance(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").select("a", "b", byte_levenshtein(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


@query("number_codes", "SELECT o_orderkey, upper(lpad(to_hex(((o_custkey - 700)::hugeint + 9223372036854775808)::ubigint), 16, '0')) AS code, o_custkey - 700 AS decoded FROM orders")
def number_codes(spark, sf_dir):
    code = encode_int64(F.col("o_custkey") - 700)
    return _table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"), decode_int64(code).alias("decoded"))


# -- index tables ------------------------------------------------------------


@query("postings_freq", f"WITH {_DOC_TOKENS} SELECT 'text' AS field, term, doc_id, count(*) AS freq, min(pos)::bigint AS first_pos, max(pos)::bigint AS last_pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok) GROUP BY ALL")
def postings_freq(spark, sf_dir):
    p = _texts(spark, sf_dir).postings()
    ends = (F.element_at("positions", at).cast("bigint") for at in (1, -1))
    return p.select("field", "term", "doc_id", "freq", *(e.alias(n) for e, n in zip(ends, ("first_pos", "last_pos"))))


@query("term_dictionary", f"WITH {_DOC_TOKENS}, x AS (SELECT 'text' AS field, unnest(list_distinct(t)) AS term FROM tok UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'n_chars', n_chars::varchar FROM documents) SELECT field, term, count(*) AS df FROM x GROUP BY ALL")
def term_dictionary(spark, sf_dir):
    return _docs(spark, sf_dir).term_dictionary()


@query("doc_lengths", f"WITH {_DOC_TOKENS} SELECT doc_id, 'text' AS field, len(t)::bigint AS length FROM tok")
def doc_lengths(spark, sf_dir):
    return index.doc_lengths(_texts(spark, sf_dir).corpus).withColumn("length", F.col("length").cast("bigint"))


@query("field_stats", f"WITH x AS (SELECT 'text' AS field, len({_tokens('text')}) AS n FROM documents UNION ALL SELECT 'lang', len({_tokens('lang')}) FROM documents UNION ALL SELECT 'source', len({_tokens('source')}) FROM documents UNION ALL SELECT 'n_chars', len({_tokens('n_chars::varchar')}) FROM documents) SELECT field, count(*) AS n_docs, round(avg(n), 6) AS avg_length FROM x GROUP BY field")
def field_stats(spark, sf_dir):
    return _docs(spark, sf_dir).field_stats().withColumn("avg_length", F.round("avg_length", 6))


@query("numeric_points", "SELECT p_partkey AS doc_id, 'p_size' AS field, p_size::double AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def numeric_points(spark, sf_dir):
    return index.numeric_points(_parts(spark, sf_dir).corpus)


@query("prefix_terms", f"WITH {_DOC_TOKENS} SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM tok) WHERE starts_with(term, 'the')")
def prefix_terms(spark, sf_dir):
    return expand.completions(_texts(spark, sf_dir).corpus, "text", "the")


# -- ranked boolean search -----------------------------------------------------


@query("bm25_bool", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('from')} + {_bm25('this')}, 6) AS score FROM tok WHERE {_has('from')} AND NOT {_has('er')} ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_bool(spark, sf_dir):
    q = Builder().must("text", "from").should("text", "this").must_not("text", "er").build()
    return _scored(_texts(spark, sf_dir).search(q, 10).hits)


@query("bm25_must", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('of')} + {_bm25('from')}, 6) AS score FROM tok WHERE {_has('of')} AND {_has('from')}")
def bm25_must(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).search(Builder().must("text", "of").must("text", "from").build()).hits)


@query("bm25_should", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('was')} + {_bm25('by')}, 6) AS score FROM tok WHERE {_has('was')} OR {_has('by')}")
def bm25_should(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).search(Builder().should("text", "was").should("text", "by").build()).hits)


@query("bm25_params", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('this', k1=2.0, b=0.25)}, 6) AS score FROM tok WHERE {_has('this')}")
def bm25_params(spark, sf_dir):
    return _scored(_texts(spark, sf_dir, bm25=Bm25(2.0, 0.25)).search(Builder().must("text", "this").build()).hits)


@query("bm25_documents_mode", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('this')}, 6) AS score FROM tok WHERE {_has('this')}")
def bm25_documents_mode(spark, sf_dir):
    return _scored(_docs(spark, sf_dir, n_mode="documents").search(Builder().must("text", "this").build()).hits)


_PART_TOKENS = f"nm AS (SELECT p_partkey, {_tokens('p_name')} AS t FROM part), tp AS (SELECT p_partkey, {_tokens('p_type')} AS t FROM part)"
_PART_N = "(SELECT 5 * count(*) FROM part)"


@query("bm25_multifield_boost", f"WITH {_PART_TOKENS} SELECT p_partkey, round(coalesce(CASE WHEN {_has('red', 'nm.t')} THEN {_bm25('red', _PART_N, source='nm', boost=2.0)} END, 0) + coalesce(CASE WHEN {_has('economy', 'tp.t')} THEN {_bm25('economy', _PART_N, source='tp')} END, 0), 6) AS score FROM nm JOIN tp USING (p_partkey) WHERE {_has('red', 'nm.t')} OR {_has('economy', 'tp.t')}")
def bm25_multifield_boost(spark, sf_dir):
    return _scored(_parts(spark, sf_dir).search(Builder().should("p_name", "red").should("p_type", "economy").build()).hits, "p_partkey")


@query("must_not_only_empty", "SELECT doc_id, 0.0::double AS score FROM documents WHERE false")
def must_not_only_empty(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).search(Builder().must_not("text", "the").build()).hits)


@query("phrase2", f"WITH {_DOC_TOKENS} SELECT doc_id, 0.0::double AS score FROM tok WHERE {_phrase(['of', 'the'])}")
def phrase2(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).search(Builder().phrase("text", "of", "the").build()).hits)


@query("phrase3", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('in')}, 6) AS score FROM tok WHERE {_phrase(['of', 'the', 'in'])} AND {_has('in')}")
def phrase3(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).search(Builder().must("text", "in").phrase("text", "of", "the", "in").build()).hits)


@query("stored_index_search", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('from')} + {_bm25('this')}, 6) AS score FROM tok WHERE {_has('from')} AND NOT {_has('er')} ORDER BY 2 DESC, 1 LIMIT 10")
def stored_index_search(spark, sf_dir):
    q = Builder().must("text", "from").should("text", "this").must_not("text", "er").build()
    return _scored(_texts(spark, sf_dir).use_index().search(q, 10).hits)


@query("stored_index_phrase", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('in')}, 6) AS score FROM tok WHERE {_phrase(['of', 'the'])} AND {_has('in')}")
def stored_index_phrase(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).use_index().search(Builder().must("text", "in").phrase("text", "of", "the").build()).hits)


@query("phrase_stopgap", f"WITH {_DOC_TOKENS} SELECT doc_id, 0.0::double AS score FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'er' AND t[i + 1] = 'st')) > 0")
def phrase_stopgap(spark, sf_dir):
    return _scored(_texts(spark, sf_dir, analyzer=STOPPED).search(Builder().phrase("text", "er", "st").build()).hits)


@query("keyword_clause", "SELECT doc_id, 0.0::double AS score FROM documents WHERE lang = 'fr' AND source = 'src3'")
def keyword_clause(spark, sf_dir):
    hits = _docs(spark, sf_dir).search(Builder().must("lang", "fr").must("source", "src3").build()).hits
    return hits.select("doc_id", F.lit(0.0).alias("score"))


@query("synonym_should", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('was')} + {_bm25('with')} + {_bm25('by')}, 6) AS score FROM tok WHERE {_has('was')} OR {_has('with')} OR {_has('by')}")
def synonym_should(spark, sf_dir):
    return _scored(_texts(spark, sf_dir, synonyms={"was": ("with", "by")}).search(Builder().should("text", "was").build()).hits)


@query("synonym_must", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('was')} + {_bm25('with')}, 6) AS score FROM tok JOIN documents USING (doc_id) WHERE ({_has('was')} OR {_has('with')}) AND NOT {_has('er')}")
def synonym_must(spark, sf_dir):
    q = Builder().must("text", "was").must_not("text", "er").build()
    return _scored(_texts(spark, sf_dir, synonyms={"was": ("with",), "er": ("the",)}).search(q).hits)


# -- filters ----------------------------------------------------------------------


def _range_query(name: str, sql_rule: str, build):
    @query(name, f"SELECT p_partkey, 0.0::double AS score FROM part WHERE {sql_rule}")
    def run(spark, sf_dir):
        return _scored(_parts(spark, sf_dir).search(build(Builder()).build()).hits, "p_partkey")

    return run


_range_query("range_closed", "p_retailprice BETWEEN 950 AND 1200", lambda b: b.range("p_retailprice", 950, 1200))
_range_query("range_open", "p_size >= 40", lambda b: b.range("p_size", gte=40))
_range_query("range_exclusive", "p_size > 10 AND p_size < 12", lambda b: b.range("p_size", gt=10, lt=12))
_range_query("multi_range", "p_size <= 20 AND p_retailprice >= 1000", lambda b: b.range("p_size", lte=20).range("p_retailprice", gte=1000))
_range_query("range_of_keyword_empty", "false", lambda b: b.range("p_brand", gte=0))


@query("text_range", f"WITH {_DOC_TOKENS} SELECT doc_id, n_chars FROM tok JOIN documents USING (doc_id) WHERE {_has('from')} AND n_chars BETWEEN 500 AND 2000")
def text_range(spark, sf_dir):
    hits = _docs(spark, sf_dir).search(Builder().must("text", "from").range("n_chars", 500, 2000).build()).hits
    return hits.select("doc_id", F.col("fields")["n_chars"].cast("bigint").alias("n_chars"))


@query("lineitem_range", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount > 0.05")
def lineitem_range(spark, sf_dir):
    mapping = {"l_quantity": FieldMapping("float"), "l_discount": FieldMapping("float")}
    rows = _table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("doc_id"), "l_quantity", "l_discount")
    engine = SearchEngine(spark, EngineConfig(mapping=mapping)).index(rows, check_ids=False)
    hits = engine.search(Builder().range("l_quantity", 10, 20).range("l_discount", gt=0.05).build()).hits
    return hits.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("fields")["l_quantity"].cast("double")), 2).alias("quantity"))


@query("terms_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value >= 50")
def terms_in(spark, sf_dir):
    hits = _events(spark, sf_dir).search(Builder().range("value", gte=50).terms("event_type", "click", "purchase").build()).hits
    return hits.select(F.col("doc_id").alias("event_id"), F.col("fields")["event_type"].alias("event_type"))


@query("terms_multi", f"WITH {_DOC_TOKENS} SELECT doc_id FROM tok JOIN documents USING (doc_id) WHERE {_has('the')} AND lang IN ('en', 'de') AND source IN ('src1', 'src2')")
def terms_multi(spark, sf_dir):
    q = Builder().must("text", "the").terms("lang", "en", "de").terms("source", "src1", "src2").build()
    return _docs(spark, sf_dir).search(q).hits.select("doc_id")


@query("regex_raw", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/[0-9]+(#top)?$')")
def regex_raw(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.lit(1).alias("one"))
    engine = SearchEngine(spark, EngineConfig(mapping={"url": FieldMapping("keyword")})).index(rows, "page_id", check_ids=False)
    hits = engine.search(Builder().range("one", gte=0).regex("url", r"/en/[0-9]+(#top)?$").build()).hits
    return hits.select(F.col("doc_id").alias("page_id"), F.col("fields")["url"].alias("url"))


@query("regex_multi", f"WITH {_DOC_TOKENS} SELECT doc_id FROM tok JOIN documents USING (doc_id) WHERE {_has('the')} AND regexp_matches(text, '[A-Z][a-z]+ed ') AND regexp_matches(source, '^src1[0-5]$')")
def regex_multi(spark, sf_dir):
    q = Builder().must("text", "the").regex("text", "[A-Z][a-z]+ed ").regex("source", "^src1[0-5]$").build()
    return _docs(spark, sf_dir).search(q).hits.select("doc_id")


@query("regex_invalid_empty", "SELECT doc_id FROM documents WHERE false")
def regex_invalid_empty(spark, sf_dir):
    return _docs(spark, sf_dir).search(Builder().must("text", "the").regex("text", "(?=a").build()).hits.select("doc_id")


# -- order and pages ------------------------------------------------------------------


def _placed(hits: DataFrame, name: str, *fields: str) -> DataFrame:
    return hits.select(F.col("doc_id").alias(name), *(F.col("fields")[f].alias(f) for f in fields))


@query("top_k", "SELECT p_partkey, 0.0::double AS score FROM part WHERE p_size >= 1 ORDER BY p_partkey LIMIT 25")
def top_k(spark, sf_dir):
    return _scored(_parts(spark, sf_dir).search(Builder().range("p_size", gte=1).build(), 25).hits, "p_partkey")


@query("sort_asc", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 10 ORDER BY p_retailprice, p_partkey LIMIT 20")
def sort_asc(spark, sf_dir):
    return _placed(_parts(spark, sf_dir).search(Builder().range("p_size", gte=10).build(), 20, sort_by("p_retailprice")).hits, "p_partkey", "p_brand")


@query("sort_desc_missing_last", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice >= 1000 ORDER BY CASE WHEN o_orderkey % 100 = 0 THEN o_orderpriority END DESC NULLS LAST, o_orderkey LIMIT 3000")
def sort_desc_missing_last(spark, sf_dir):
    mapping = {"o_totalprice": FieldMapping("float"), "o_orderpriority": FieldMapping("keyword"), "key": FieldMapping("keyword")}
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderpriority")).alias("key"))
    engine = SearchEngine(spark, EngineConfig(mapping=mapping)).index(rows, "o_orderkey", check_ids=False)
    return _placed(engine.search(Builder().range("o_totalprice", gte=1000).build(), 3000, sort_by("key", "desc")).hits, "o_orderkey", "o_orderpriority")


@query("sort_multi", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 1 ORDER BY p_brand DESC, p_size, p_partkey LIMIT 100")
def sort_multi(spark, sf_dir):
    options = SearchOptions(sort=(Sort("p_brand", "desc"), Sort("p_size")))
    return _placed(_parts(spark, sf_dir).search(Builder().range("p_size", gte=1).build(), 100, options).hits, "p_partkey", "p_brand")


@query("page_offset", "SELECT p_partkey FROM part WHERE p_size >= 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30")
def page_offset(spark, sf_dir):
    options = SearchOptions(sort=(Sort("p_retailprice", "desc"),), from_=30, size=15)
    return _placed(_parts(spark, sf_dir).search(Builder().range("p_size", gte=1).build(), 0, options).hits, "p_partkey")


@query("page_after", "SELECT p_partkey FROM part WHERE p_size >= 1 ORDER BY p_size, p_partkey LIMIT 15 OFFSET 15")
def page_after(spark, sf_dir):
    engine, q = _parts(spark, sf_dir), Builder().range("p_size", gte=1).build()
    cursor = engine.search(q, 0, SearchOptions(sort=(Sort("p_size"),), size=15)).next_cursor()
    return _placed(engine.search(q, 0, SearchOptions(sort=(Sort("p_size"),), size=15, search_after=cursor)).hits, "p_partkey")


@query("page_after_unknown_empty", "SELECT p_partkey FROM part WHERE false")
def page_after_unknown_empty(spark, sf_dir):
    options = SearchOptions(sort=(Sort("p_size"),), search_after=Cursor("1", -1))
    return _placed(_parts(spark, sf_dir).search(Builder().range("p_size", gte=1).build(), 0, options).hits, "p_partkey")


# -- aggregations ------------------------------------------------------------------------


@query("agg_terms", f"WITH {_DOC_TOKENS} SELECT lang AS key, count(*) AS count FROM tok JOIN documents USING (doc_id) WHERE {_has('in')} GROUP BY lang")
def agg_terms(spark, sf_dir):
    return _docs(spark, sf_dir).aggregate(Builder().must("text", "in").build(), "lang")


@query("agg_terms_all", "SELECT source AS key, count(*) AS count FROM documents GROUP BY source")
def agg_terms_all(spark, sf_dir):
    return _docs(spark, sf_dir).aggregate(Query(), "source")


@query("agg_terms_topk", "SELECT p_brand AS key, count(*) AS count FROM part WHERE p_size >= 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg_terms_topk(spark, sf_dir):
    return _parts(spark, sf_dir).aggregate(Builder().range("p_size", gte=20).build(), "p_brand", 5)


@query("agg_terms_filtered", "SELECT event_type AS key, count(*) AS count FROM events WHERE value < 10 GROUP BY 1")
def agg_terms_filtered(spark, sf_dir):
    return _events(spark, sf_dir).aggregate(Builder().range("value", lt=10).build(), "event_type")


_METRIC_COLUMNS = "count(x) AS count, round(coalesce(sum(x), 0), 4) AS sum, round(coalesce(avg(x), 0), 4) AS avg, round(coalesce(min(x), 0), 4) AS min, round(coalesce(max(x), 0), 4) AS max"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("count", *(F.round(c, 4).alias(c) for c in ("sum", "avg", "min", "max")))


@query("metrics", f"WITH {_DOC_TOKENS} SELECT {_METRIC_COLUMNS} FROM (SELECT n_chars::double AS x FROM tok JOIN documents USING (doc_id) WHERE {_has('this')})")
def metrics(spark, sf_dir):
    return _rounded(_docs(spark, sf_dir).metrics(Builder().must("text", "this").build(), "n_chars"))


@query("metrics_of_range", f"SELECT {_METRIC_COLUMNS} FROM (SELECT value AS x FROM events WHERE user_id <= 100)")
def metrics_of_range(spark, sf_dir):
    return _rounded(_events(spark, sf_dir).metrics(Builder().range("user_id", lte=100).build(), "value"))


@query("metrics_not_numeric", f"SELECT {_METRIC_COLUMNS} FROM (SELECT NULL::double AS x)")
def metrics_not_numeric(spark, sf_dir):
    return _rounded(_docs(spark, sf_dir).metrics(Builder().must("text", "this").build(), "lang"))


@query("metrics_empty", f"SELECT {_METRIC_COLUMNS} FROM (SELECT NULL::double AS x)")
def metrics_empty(spark, sf_dir):
    return _rounded(_docs(spark, sf_dir).metrics(Query(), "n_chars"))


# -- term expansion -----------------------------------------------------------------------


def _expansion_sql(test: str, limit: str = "") -> str:
    return f"""
WITH {_DOC_TOKENS}, hit AS (SELECT doc_id, term, len(t)::double AS len, len(list_filter(t, lambda x: x = term))::double AS f FROM (SELECT doc_id, t, unnest(list_distinct(t)) AS term FROM tok) WHERE {test}),
df AS (SELECT term, count(*)::double AS df FROM hit GROUP BY term),
s AS (SELECT (SELECT count(*) FROM tok)::double AS n, (SELECT avg(len(t)) FROM tok) AS a)
SELECT doc_id, round(max(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (f * 2.2::double) / (f + 1.2::double * (0.25::double + 0.75::double * (len / a)))), 6) AS score
FROM hit JOIN df USING (term), s GROUP BY doc_id {limit}"""


@query("fuzzy_1", _expansion_sql("levenshtein(term, 'from') <= 1"))
def fuzzy_1(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).fuzzy_search("text", "from", 1))


@query("fuzzy_2", _expansion_sql("levenshtein(term, 'étant') <= 2", "ORDER BY 2 DESC, 1 LIMIT 50"))
def fuzzy_2(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).fuzzy_search("text", "étant", 2, 50))


@query("wildcard_star", _expansion_sql("regexp_matches(term, '^th.*ing$')"))
def wildcard_star(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).wildcard_search("text", "th*ing"))


@query("wildcard_q", _expansion_sql("regexp_matches(term, '^th.s$')", "ORDER BY 2 DESC, 1 LIMIT 20"))
def wildcard_q(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).wildcard_search("text", "th?s", 20))


@query("prefix", f"WITH {_DOC_TOKENS} SELECT doc_id, 0.0::double AS score FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'whth'))) > 0")
def prefix(spark, sf_dir):
    return _scored(_texts(spark, sf_dir).prefix_search("text", "whth"))


# -- vectors ----------------------------------------------------------------------------------

_TARGET = "[" + ", ".join(f"{(i * 7 % 11 - 5) / 5.0}" for i in range(64)) + "]::double[]"
_VECTOR = [(i * 7 % 11 - 5) / 5.0 for i in range(64)]
_COSINE = f"list_cosine_similarity(embedding::double[], {_TARGET})"


@query("vector_topk", f"SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings WHERE {_COSINE} > 0 ORDER BY {_COSINE} DESC, 1 LIMIT 20")
def vector_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    engine = SearchEngine(spark, EngineConfig(mapping={"embedding": FieldMapping("vector")})).index(rows, "vec_id", check_ids=False)
    return _scored(engine.vector_search("embedding", _VECTOR, 20), "vec_id")


def _hybrid_sql(alpha: float) -> str:
    return f"""
WITH {_DOC_TOKENS}, b AS (SELECT doc_id, {_bm25('this')} AS s FROM tok WHERE {_has('this')}),
v AS (SELECT vec_id AS doc_id, {_COSINE} AS c FROM embeddings WHERE {_COSINE} > 0),
h AS (SELECT doc_id, {alpha}::double * coalesce(s, 0) + {1 - alpha}::double * coalesce(c, 0) AS x FROM b FULL JOIN v USING (doc_id))
SELECT doc_id, round(x, 6) AS score FROM h WHERE x > 0 ORDER BY x DESC, 1 LIMIT 40"""


def _hybrid(name: str, alpha: float):
    @query(name, _hybrid_sql(alpha))
    def run(spark, sf_dir):
        return _scored(_vectors(spark, sf_dir).hybrid_search(Builder().must("text", "this").build(), "embedding", _VECTOR, alpha, 40))

    return run


_hybrid("hybrid_05", 0.5)
_hybrid("hybrid_bm25", 1.0)
_hybrid("hybrid_vector", 0.0)


# -- highlights ----------------------------------------------------------------------------------


def _highlight_sql(opening: str, closing: str) -> str:
    first = f"{_tokens('w')}[1]"
    return f"""
WITH {_DOC_TOKENS}, hit AS (SELECT doc_id, text, {_words('text')} AS w FROM documents JOIN tok USING (doc_id) WHERE {_has('from')}),
marked AS (SELECT doc_id, array_to_string(list_transform(w, lambda w: CASE WHEN {first} IN ('from', 'this') AND ({first} = 'from' OR list_contains({_tokens('text')}, 'this')) THEN '{opening}' || w || '{closing}' ELSE w END), ' ') AS snippet, array_to_string(w, ' ') AS plain FROM hit)
SELECT doc_id, snippet FROM marked WHERE snippet <> plain"""


def _highlighted(spark, sf_dir, **options) -> DataFrame:
    q = Builder().must("text", "from").should("text", "this").build()
    hits = _texts(spark, sf_dir).search(q, 0, SearchOptions(highlight=True, **options)).hits
    # The outer form: else the optimizer would mark the text up once more to test it.
    return hits.select("doc_id", F.explode_outer("highlights").alias("h")).where("h is not null").select("doc_id", "h.snippet")


@query("highlight_em", _highlight_sql("<em>", "</em>"))
def highlight_em(spark, sf_dir):
    return _highlighted(spark, sf_dir)


@query("highlight_custom", _highlight_sql("**", "**"))
def highlight_custom(spark, sf_dir):
    return _highlighted(spark, sf_dir, markers=("**", "**"))


# -- types and mappings -----------------------------------------------------------------------------

_INT = r"regexp_matches({0}, '^[+-]?[0-9]+$') AND try_cast({0} AS bigint) IS NOT NULL"
_FLOAT = r"regexp_matches({0}, '(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?|nan)$')"


def _type_sql(v: str) -> str:
    return f"CASE WHEN {_INT.format(v)} THEN 'integer' WHEN {_FLOAT.format(v)} THEN 'float' WHEN {v} IN ('true', 'false') THEN 'boolean' WHEN octet_length(encode({v})) < 64 AND NOT contains({v}, ' ') THEN 'keyword' ELSE 'text' END"


_VALUES = "SELECT event_id, event_type AS a, round(value, 2)::varchar AS b, CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN user_id::varchar ELSE props END AS c FROM events"


def _event_values(spark, sf_dir) -> DataFrame:
    third = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise(F.col("props"))
    return _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("a"), third.alias("c"))


@query("infer_types", f"SELECT event_id, {_type_sql('a')} AS a_type, {_type_sql('c')} AS c_type FROM ({_VALUES})")
def infer_types(spark, sf_dir):
    return _event_values(spark, sf_dir).select("event_id", *(infer_type(F.col(c)).alias(f"{c}_type") for c in "ac"))


@query("mapping_promote", f"SELECT 'a' AS field, 'keyword' AS type UNION ALL SELECT 'c', CASE WHEN count(DISTINCT {_type_sql('c')}) > 1 THEN 'text' ELSE min({_type_sql('c')}) END FROM ({_VALUES})")
def mapping_promote(spark, sf_dir):
    return infer_mapping(_event_values(spark, sf_dir), "event_id").table(spark).select("field", "type")


@query("inferred_type_sets", f"SELECT 'a' AS field, array_to_string(list_sort(list(DISTINCT {_type_sql('a')})), ',') AS types FROM ({_VALUES}) UNION ALL SELECT 'c', array_to_string(list_sort(list(DISTINCT {_type_sql('c')})), ',') FROM ({_VALUES})")
def inferred_type_sets(spark, sf_dir):
    return inferred_types(_event_values(spark, sf_dir), ["a", "c"]).withColumn("types", F.array_join("types", ","))


def _column_type_sql(c: str) -> str:
    return f"SELECT '{c}' AS field, CASE WHEN count(DISTINCT {_type_sql(c)}) > 1 THEN 'text' ELSE min({_type_sql(c)}) END AS type, true AS index, true AS store FROM documents"


@query("schema_table", " UNION ALL ".join(map(_column_type_sql, ("lang", "source", "text"))) + " UNION ALL SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'integer' ELSE '' END, true, true FROM (DESCRIBE documents) WHERE column_name = 'n_chars'")
def schema_table(spark, sf_dir):
    """The mapping that an engine infers from the values."""
    engine = SearchEngine(spark).index(_table(spark, sf_dir, "documents"), check_ids=False)
    return engine.schema.table(spark).select("field", "type", "index", "store")


@query("stored_projection", f"WITH {_DOC_TOKENS} SELECT doc_id, lang AS stored FROM tok JOIN documents USING (doc_id) WHERE {_has('this')}")
def stored_projection(spark, sf_dir):
    mapping = {"text": FieldMapping("text", store=False), "lang": FieldMapping("keyword", index=False), "source": FieldMapping("skip"), "n_chars": FieldMapping("integer", store=False)}
    engine = SearchEngine(spark, EngineConfig(mapping=mapping)).index(_table(spark, sf_dir, "documents"), check_ids=False)
    hits = engine.search(Builder().must("text", "this").build()).hits
    return hits.select("doc_id", F.array_join(F.map_values("fields"), ",").alias("stored"))


# -- writes and recovery ------------------------------------------------------------------------------


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    return documents.latest(_table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("upsert_engine", "SELECT p_brand AS key, count(*) AS count FROM (SELECT CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS p_brand FROM part) GROUP BY 1")
def upsert_engine(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand", "p_size")
    engine = SearchEngine(spark, EngineConfig(mapping={"p_brand": FieldMapping("keyword")})).index(rows, check_ids=False)
    engine.index(rows.where("p_size > 25").withColumn("p_brand", F.lit("big")), check_ids=False)
    return engine.aggregate(Query(), "p_brand")


@query("delete_anti", "SELECT count(*) AS size FROM documents WHERE lang <> 'fr'")
def delete_anti(spark, sf_dir):
    engine = _docs(spark, sf_dir)
    engine.delete_all(_table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id"))
    return engine.corpus.agg(F.count(F.lit(1)).alias("size"))


@query("wal_fold", "SELECT user_id::varchar AS doc_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, value::varchar AS seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def wal_fold(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("index")
    entries = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("doc_id"), F.col("value").alias("fields"))
    return fold(entries).select("doc_id", "op", F.col("fields").cast("string").alias("seen"))


@query("delta_recover", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delta_recover(spark, sf_dir):
    return documents.delete(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@query("json_codec", """SELECT doc_id, '{"id":"' || doc_id || '","fields":{"lang":{"value":"' || lang || '","boost":1.0},"source":{"value":"' || source || '","boost":2.5}}}' AS json, lang, source, 2.5::double AS boost FROM documents""")
def json_codec(spark, sf_dir):
    coded = documents.to_json(_table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"], boosts={"source": 2.5})
    back = documents.from_json(coded, "json", ["lang", "source"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.col("boost_source").alias("boost"))
    return coded.join(back, "doc_id")


@query("reindex_analyzer", f"WITH tok AS (SELECT doc_id, {_words('text')} AS t FROM documents) SELECT doc_id FROM tok WHERE {_has('The')}")
def reindex_analyzer(spark, sf_dir):
    engine = _docs(spark, sf_dir)
    mapping = dict(engine.config.mapping)
    fresh = engine.reindex(EngineConfig(analyzer=Analyzer(whitespace_tokenizer), mapping=mapping))
    return fresh.search(Builder().must("text", "The").build()).hits.select("doc_id")
