"""Queries on documents and conversations: chunking, retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..session import table
from ..sources import files as S
from .registry import query
from .tables import CHUNKS, chunks

_TOK = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_+.#/-]*')"


def _queries(spark, d):
    q = table(spark, d, "benchmark")
    return q.select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"))


_Q = """q AS (SELECT item_id AS qid, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark)"""
_BM = f"""{CHUNKS}, {_Q}, dt AS (SELECT id, {_TOK.format("section || ' ' || text")} AS t FROM ch), ix AS (SELECT id, len(t) AS l, unnest(t) AS term FROM dt),
    tf AS (SELECT id, term, l, count(*) AS tf FROM ix GROUP BY ALL), st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS mean FROM dt),
    qt AS (SELECT qid, term, count(*) AS qw FROM (SELECT qid, unnest({_TOK.format("query")}) AS term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT qid, id, sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS bm25 FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query("q1_tokens", f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n, md5(array_to_string({_TOK.format('text')}, ' ')) AS tokens FROM documents")
def q1(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("fn_normalise", r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(role || '  ' || text || chr(9), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '')) AS text FROM conversations""")
def normalised(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(T.normalise(F.concat("role", F.lit(" \0"), "text", F.lit("\t")))).alias("text"))


@query("ag1_document_frequency", f"""WITH {CHUNKS}, dt AS (SELECT id, {_TOK.format("section || ' ' || text")} AS t FROM ch), x AS (SELECT id, unnest(list_distinct(t)) AS term FROM dt) SELECT term, count(*) AS df FROM x GROUP BY 1""")
def ag1(spark, d):
    return R.inverted_index(chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query("ag2_term_frequency", f"""WITH {CHUNKS}, ix AS (SELECT id, unnest({_TOK.format("section || ' ' || text")}) AS term FROM ch) SELECT id, term, count(*) AS tf FROM ix GROUP BY ALL""")
def ag2(spark, d):
    return R.inverted_index(chunks(spark, d)).select("id", "term", "tf")


@query("q2_bm25", f"WITH {_BM} SELECT qid, id, round(bm25, 6) AS bm25 FROM bm")
def q2(spark, d):
    return R.bm25(_queries(spark, d), chunks(spark, d)).select("qid", "id", F.round("bm25", 6).alias("bm25"))


@query("pf1_chapter_filter", f"WITH {_BM.replace('FROM documents)', 'FROM documents WHERE CAST(regexp_extract(source, ' + chr(39) + '([0-9]+)' + chr(39) + ', 1) AS INT) = 3)')} SELECT qid, id, round(bm25, 6) AS bm25 FROM bm")
def pf1(spark, d):
    return R.bm25(_queries(spark, d), chunks(spark, d).where("chapter = 3")).select("qid", "id", F.round("bm25", 6).alias("bm25"))


# names that the test texts hold; a longer one holds a shorter one
ALIASES = {"the": ["definite article", "thereon"], "and": ["as well as", "plus"], "ansh": ["esh"]}
CONCEPTS = [("er-st", "erst", 3), ("thention", "thention", 5), ("definite", "the", 7), ("ble", "ble", 9), ("inon", "that inon", 11)]


@query("q9_rank")
def q9(spark, d):
    q = T.chapter_hints(T.expand_queries(_queries(spark, d), ALIASES), CONCEPTS, ALIASES)
    hints = q.where("size(chapters) = 1").select("qid", F.col("chapters")[0].alias("chapter"))
    pointers = q.where("qid % 7 = 0").select("qid", F.lit("src3.pdf").alias("source"), (F.col("qid") % 50 + 1).cast("int").alias("page"))
    out = R.rank(q, chunks(spark, d), 5, pointers=pointers, hints=hints)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "rank")


_STANDS = "regexp_matches(' ' || lower(query) || ' ', '[^a-z0-9_/-]({})[^a-z0-9_/-]')"


@query("fn_expand_queries", f"""WITH {_Q}, m AS (SELECT qid, query, {_STANDS.format('the|definite article|thereon')} AS a, {_STANDS.format('and|as well as|plus')} AS b, {_STANDS.format('ansh|esh')} AS c FROM q)
    SELECT qid, query || CASE WHEN a THEN ' the definite article thereon' ELSE '' END || CASE WHEN b THEN ' and as well as plus' ELSE '' END || CASE WHEN c THEN ' ansh esh' ELSE '' END AS expanded FROM m""")
def expand(spark, d):
    return T.expand_queries(_queries(spark, d), ALIASES).select("qid", "expanded")


@query("fn_chapter_hints", f"""WITH {_Q}, m AS (SELECT qid, {_STANDS.format('erst|er st')} AS c3, {_STANDS.format('thention')} AS c5, {_STANDS.format('ble')} AS c9, {_STANDS.format('that inon|inon')} AS c11, {_STANDS.format('the|definite')} AS c7 FROM q)
    SELECT qid, array_to_string(list_filter([CASE WHEN c3 THEN 3 END, CASE WHEN c5 THEN 5 END, CASE WHEN c7 THEN 7 END, CASE WHEN c9 THEN 9 END, CASE WHEN c11 THEN 11 END], lambda x: x IS NOT NULL), ',') AS chapters FROM m""")
def hints(spark, d):
    h = T.chapter_hints(_queries(spark, d), CONCEPTS, ALIASES)
    return h.select("qid", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"))


def _lexical(spark, d):
    from ..operators.temporal import top_k

    c = chunks(spark, d)
    b = R.bm25(_queries(spark, d), c).withColumn("score", F.round("bm25", 6))
    return top_k(b, ["qid"], 5, F.desc("score"), F.col("id")).join(c.select("id", "chapter", "page_start", "source"), "id")


_RK = f"""{_BM}, rk AS (SELECT qid, id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, id) AS rank FROM bm), t5 AS (SELECT rk.*, chapter, page_start FROM rk JOIN ch USING (id) WHERE rank <= 5)"""


@query("tk1_top_k", f"WITH {_RK} SELECT qid, id, score, rank FROM t5")
def tk1(spark, d):
    return _lexical(spark, d).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("tk3_evidence_pages", f"""WITH {_RK}, p AS (SELECT qid, chapter, page_start, max(score) AS score FROM t5 GROUP BY ALL), m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM p),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, 'src' || chapter || '.pdf', page_start) AS rank FROM m WHERE m >= 8 AND score >= 4)
    SELECT qid, 'src' || chapter || '.pdf' AS source, page_start, score, rank FROM g WHERE rank <= 4""")
def tk3(spark, d):
    return R.evidence_pages(_lexical(spark, d)).select("qid", "source", "page_start", "score", F.col("rank").cast("long").alias("rank"))


@query("ag18_retrieval_metrics", f"""WITH {_RK}, c AS (SELECT qid, CASE WHEN qid % 5 = 4 THEN [] ELSE [qid % 20, (qid * 3 + 1) % 20] END AS expected, CASE WHEN qid % 2 = 0 THEN 1 END AS paged FROM q),
    a AS (SELECT qid, any_value(expected) AS expected, any_value(paged) AS paged, max(chapter) FILTER (rank = 1) AS c1, max(page_start) FILTER (rank = 1) AS p1, max(score) FILTER (rank = 1) AS s1, list(chapter) FILTER (chapter IS NOT NULL) AS chs, count(t5.id) AS n FROM c LEFT JOIN t5 USING (qid) GROUP BY qid),
    f AS (SELECT len(expected) = 0 AS neg, len(expected) = 0 AND (n = 0 OR s1 < 8) AS neg_ok, coalesce(list_contains(expected, c1), false) AS h1, coalesce(list_has_any(expected, chs), false) AS h5, n > 0 AS cite, paged, c1 = qid % 20 AND p1 BETWEEN 1 AND 25 AS pg FROM a)
    SELECT count(*) AS cases, count(*) FILTER (neg) AS negative_cases, round(count(*) FILTER (neg_ok) / count(*) FILTER (neg), 6) AS negative_rejection_rate, round(count(*) FILTER (NOT neg AND h1) / count(*) FILTER (NOT neg), 6) AS hit_at_1,
      round(count(*) FILTER (NOT neg AND h5) / count(*) FILTER (NOT neg), 6) AS recall_at_5, round(count(*) FILTER (NOT neg AND cite) / count(*) FILTER (NOT neg), 6) AS citation_valid,
      round(count(*) FILTER (NOT neg AND paged = 1 AND pg) / count(*) FILTER (NOT neg AND paged = 1), 6) AS page_hit_at_1 FROM f""")
def ag18(spark, d):
    q = _queries(spark, d)
    expected = F.when(F.col("qid") % 5 == 4, F.array().cast("array<int>")).otherwise(F.array((F.col("qid") % 20).cast("int"), ((F.col("qid") * 3 + 1) % 20).cast("int")))
    pages = F.when(F.col("qid") % 2 == 0, F.array(F.struct((F.col("qid") % 20).cast("int").alias("chapter"), F.lit(1).alias("lo"), F.lit(25).alias("hi"))))
    out = R.evaluate(q.select("qid", expected.alias("expected"), pages.alias("pages")), _lexical(spark, d).select("qid", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), "chapter", "page_start", "source"))
    return out.select("cases", "negative_cases", *[F.round(x, 6).alias(x) for x in ("negative_rejection_rate", "hit_at_1", "recall_at_5", "citation_valid", "page_hit_at_1")])


@query("j11_range_join", """SELECT doc_id, lo FROM (SELECT doc_id, CAST(doc_id % 50 + 1 AS INT) AS p FROM documents) d JOIN (SELECT unnest([1, 10, 40]) AS lo) r ON p BETWEEN lo AND lo + 4""")
def j11(spark, d):
    r = spark.createDataFrame([(1, 5), (10, 14), (40, 44)], "lo int, hi int")
    page = chunks(spark, d).select(F.col("id").alias("doc_id"), F.col("page_start").alias("p"))
    return page.join(F.broadcast(r.select("lo", F.explode(F.sequence("lo", "hi")).alias("p"))), "p").select("doc_id", "lo")


@query("j12_pointer_semi_join", """SELECT doc_id FROM documents WHERE (source = 'src1' AND doc_id % 50 + 1 BETWEEN 3 AND 9) OR (source = 'src2' AND doc_id % 50 + 1 = 7)""")
def j12(spark, d):
    p = spark.createDataFrame([("src1.pdf", 3, 9), ("src2.pdf", 7, 7)], "source string, lo int, hi int").select("source", F.explode(F.sequence("lo", "hi")).alias("page_start"))
    return chunks(spark, d).join(F.broadcast(p), ["source", "page_start"], "left_semi").select(F.col("id").alias("doc_id"))


@query("pf2_page_lookup", f"""WITH {CHUNKS} SELECT chapter, page_start, md5(string_agg(text, chr(10) || chr(10) ORDER BY id)) AS body, count(*) AS blocks FROM ch WHERE chapter IN (1, 2) AND page_start <= 10 GROUP BY ALL""")
def pf2(spark, d):
    c = chunks(spark, d).where("chapter in (1, 2) and page_start <= 10").groupBy("chapter", "page_start")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
    return c.agg(F.md5(F.array_join(blocks, "\n\n")).alias("body"), F.count("*").alias("blocks"))


@query("pf3_faceted_filter", """SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src3') AND contains(lower(source || ' ' || lang || ' ' || text), 'license')""")
def pf3(spark, d):
    docs = table(spark, d, "documents")
    return docs.where((F.col("lang") == "en") & F.col("source").isin("src0", "src3") & F.lower(F.concat_ws(" ", "source", "lang", "text")).contains("license")).select("doc_id")


@query("pf4_group_by_chapter", f"""WITH {CHUNKS} SELECT chapter, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM ch WHERE contains(lower(text), 'the') GROUP BY chapter""")
def pf4(spark, d):
    c = chunks(spark, d).where(F.lower("text").contains("the")).groupBy("chapter")
    return c.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("sc6_pack_paragraphs", """WITH p AS (SELECT doc_id, [{'size': length(x), 'blocks': 0} FOR x IN list_filter([regexp_replace(trim(x), '[ \\t]+', ' ', 'g') FOR x IN string_split(text, chr(10))], lambda x: x <> '')] AS ps FROM documents)
    SELECT doc_id, list_reduce(list_prepend({'size': 0, 'blocks': 0}, ps), lambda a, b: {'size': CASE WHEN a.size > 0 AND a.size + b.size > 400 THEN b.size ELSE a.size + b.size END, 'blocks': a.blocks + CASE WHEN a.size = 0 OR a.size + b.size > 400 THEN 1 ELSE 0 END}).blocks::BIGINT AS blocks FROM p""")
def sc6(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 400)).cast("long").alias("blocks"))


@query("sc7_page_headings", """WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN left(text, 10) END AS h FROM conversations) SELECT conv_id, turn, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM l""")
def sc7(spark, d):
    from ..operators.temporal import carry_forward

    c = table(spark, d, "conversations").withColumn("h", F.when(F.col("role") == "user", F.left("text", F.lit(10))))
    return carry_forward(c, ["conv_id"], ["turn"], "h", "heading").select("conv_id", "turn", "heading")


@query("sc8_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
    m AS (SELECT doc_id, n, regexp_matches(line, '^The') AS s FROM l), e AS (SELECT doc_id, max(n) AS last FROM m GROUP BY 1)
    SELECT m.doc_id, n AS "first", coalesce(lead(n) OVER (PARTITION BY m.doc_id ORDER BY n) - 1, last) AS "last" FROM m JOIN e USING (doc_id) WHERE s""")
def sc8(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    out = S.sections(lines.select("file", (F.col("p") + 1).cast("long").alias("line_no"), "line"), "^(The)")
    return out.select(F.col("file").alias("doc_id"), "first", "last")


@query("sc3_fingerprints", "SELECT doc_id, sha256(text) AS sha256, octet_length(CAST(text AS BLOB))::BIGINT AS size FROM documents".replace("octet_length(CAST(text AS BLOB))", "strlen(text)"))
def sc3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("fn_hashed_cosine")
def hashed(spark, d):
    docs = V.with_hashed_vector(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), "v").drop("text")
    q = V.with_hashed_vector(_queries(spark, d), F.col("query"), "qv").drop("query")
    return docs.crossJoin(q).select("qid", "doc_id", F.round(V.sparse_cosine(F.col("qv"), F.col("v")), 6).alias("sim"))
