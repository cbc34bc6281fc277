"""Full text, text cleaning, vocabularies, spelling and segmentation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import catalog
from framewright.functions import text as T
from framewright.operators import fulltext, segment, textclean, vocab
from framewright.scratch import stored

GOLDEN = "500ml 2kg S00ml 20/07/2026 14:30 50% 20.000đ 0987654321 L28V001 VTV vtv1 Việt THU".split()
QUERY = "and the thtion of the"
TERMS = fulltext.terms_of(QUERY)


def _docs(spark, d):
    return catalog.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _index(spark, d):
    return stored(fulltext.postings(_docs(spark, d), "doc_id", "text"), "postings")


def f8(spark, d):
    m = fulltext.matched(_index(spark, d), "doc_id", TERMS)
    n = len(set(TERMS))
    return m.select("doc_id", "matched", F.round("bm25", 6).alias("bm25"), (F.col("matched") >= fulltext.at_least(n, 0.5)).alias("half"), (F.col("matched") >= fulltext.at_least(n, 0.85)).alias("most"), (F.col("matched") == n).alias("all_terms"))


def f9(spark, d):
    lines = _docs(spark, d).select("doc_id", F.split("text", "\n").alias("lines"))
    t = fulltext.tokens(lines, "doc_id", "lines")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("term").alias("terms"))


def f2(spark, d):
    m = fulltext.matched(_index(spark, d), "doc_id", ["of", "the"]).where("matched = 2").select("doc_id", "p0", "p1")
    m = fulltext.with_frequencies(m, ["of", "the"], (0, 3, 10))
    return m.select("doc_id", *[F.round(f"__slop{s}", 6).alias(f"slop{s}") for s in (0, 3, 10)])


def f6(spark, d):
    terms = _index(spark, d).groupBy("term").agg(F.count("*").alias("df"))
    return fulltext.expansions(terms, ["thtion", "there", "an"]).select("query_term", "term")


def f_full(spark, d):
    return fulltext.search(_index(spark, d), "doc_id", QUERY, 50)


def f12(spark, d):
    """Speech search: segments of conversations by the same boosted query."""
    s = catalog.segments(spark, d).select(F.concat_ws("-", "video_id", F.col("start_time").cast("int")).alias("segment_id"), "text")
    return fulltext.search(stored(fulltext.postings(s, "segment_id", "text"), "postings"), "segment_id", "of the", 30)


def f15(spark, d):
    w = spark.createDataFrame([("the", 0.1)], "term string, weight double")
    return fulltext.search(_index(spark, d), "doc_id", "the of and", 20, w)


def f14(spark, d):
    found = T.snippets(F.col("text"), "and the ereaan")
    return _docs(spark, d).select("doc_id", found.alias("s")).select("doc_id", "s.*")


def x1(spark, d):
    q = _docs(spark, d).select("doc_id", F.col("text").alias("q"))
    e = T.events(F.col("q"))
    return q.select("doc_id", F.size(e).alias("events"), F.array_join(e, "|").alias("joined"))


def x2(spark, d):
    q = catalog.table(spark, d, "benchmark").select("item_id", T.clean(F.col("text")).alias("q"))
    return q.select("item_id", F.array_join(T.sub_queries(F.col("q")), "|").alias("parts"), F.array_join(T.connective_parts(F.concat(F.lit("a dog and then a cat after rain, and sun, a dog "), F.col("item_id").cast("string"))), "|").alias("connective"))


def x5(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("plain_md5"), F.length(T.strip_accents(F.col("text"))).alias("n"))


def x6(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(T.glued_parts(F.regexp_replace("line", " \\| ", " - "))).alias("part_no", "part"))


def x7(spark, d):
    x = F.translate("text", "abcdefg", "⁰¹²₃₄₅ⁿ")
    return _docs(spark, d).select("doc_id", F.md5(T.math_notation(x)).alias("plain_md5"))


def x8(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("confidence", F.when(F.col("line_no") % 3 != 0, F.col("line_no") % 3 / 2.5))
    return lines.where(T.repetition("line", "confidence")).groupBy("doc_id").agg(F.count("*").alias("garbage_lines"))


def _tokens(spark, d):
    return vocab.distinct_tokens(_docs(spark, d), "text")


def x10(spark, d):
    t = _tokens(spark, d).union(spark.createDataFrame([(t,) for t in GOLDEN], "token string")).distinct()
    c = t.select("token", T.token_class(F.col("token")).alias("c"))
    return c.where("c is not null").select("token", "c.*")


def x12(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.foreign_line(F.col("line")).alias("foreign_line"))


def _dictionary(spark, d):
    en = _docs(spark, d).where("lang = 'en'")
    return vocab.domain_vocabulary(en, "doc_id", "text", 4).where(F.col("token").rlike(r"^\p{L}+$"))


def x13(spark, d):
    return vocab.resolved(_tokens(spark, d), _dictionary(spark, d), vocab.domain_vocabulary(_docs(spark, d), "source", "text", 19))


def x14(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(F.concat_ws("-", "doc_id", "line_no").alias("line_id"), "line")
    dictionary = stored(_dictionary(spark, d), "dictionary")
    table = stored(vocab.bigrams(_docs(spark, d), "doc_id", "text", dictionary), "bigrams")
    return vocab.corrected_lines(lines, "line_id", "line", dictionary, vocab.domain_vocabulary(_docs(spark, d), "source", "text", 19), table, counted=True)


def x15(spark, d):
    return vocab.suggestions(_tokens(spark, d), _dictionary(spark, d))


def _bigrams(docs):
    return stored(vocab.bigrams(docs, "doc_id", "text"), "bigrams")


def x17(spark, d):
    docs = _docs(spark, d)
    dictionary = vocab.domain_vocabulary(docs, "doc_id", "text", 2)
    return vocab.replacements(vocab.in_context(docs, "doc_id", "text"), vocab.accent_candidates(dictionary), _bigrams(docs), 2, 1.5, counted=True).select("before", "token", "after", "other", "evidence")


def x18(spark, d):
    docs = _docs(spark, d)
    return vocab.replacements(vocab.in_context(docs, "doc_id", "text"), vocab.edit_candidates(_dictionary(spark, d)), _bigrams(docs), vocab.WORD_COUNT, 10.0, counted=True).select("before", "token", "after", "other", "evidence")


def x19(spark, d):
    return _tokens(spark, d).select("token", T.risky_token(F.upper("token")).alias("risky"), T.edge_stripped(F.col("token")).alias("core"))


def a6(spark, d):
    return vocab.document_frequency(_docs(spark, d), "source", "text")


def a7(spark, d):
    return vocab.domain_vocabulary(_docs(spark, d), "source", "text", 3, 0.5)


def a8(spark, d):
    docs = _docs(spark, d)
    return vocab.watermark_vocabulary(docs, "source", "text", vocab.domain_vocabulary(docs.where("lang = 'en'"), "source", "text", 15).select("token"))


def d11(spark, d):
    return vocab.bigrams(_docs(spark, d), "doc_id", "text")


def u3(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return textclean.first_of_equal(lines, ["doc_id"], ["line_no"])


def x9(spark, d):
    docs = _docs(spark, d).select("doc_id", F.split("text", "\n").alias("texts"), F.lit(None).cast("array<array<double>>").alias("bboxs"), F.lit(None).cast("array<double>").alias("confidences"))
    found = textclean.normalised_frames(docs, ["doc_id"], foreign=True)
    return found.select("doc_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def w6(spark, d):
    return vocab.in_context(_docs(spark, d), "doc_id", "text")


def _pixels(spark, d):
    """Stored vectors as frames with pictures: a vector's numbers as 21 RGB pixels."""
    f = catalog.frames(spark, d)
    number = F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x * 500 + 128), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    return f.select(F.col("video_id").cast("long").alias("video_id"), F.col("pos").cast("int").alias("pos"), F.col("embedding").alias("vector"), F.unhex(F.array_join(number, "")).alias("pixels"))


def k5(spark, d):
    """The keyframe pipeline over all cut series; frames are the stored vectors that stand at their places."""
    return segment.keyframes(_cuts(spark, d), _pixels(spark, d), max_gap=11)


def k4h(spark, d):
    """How many colours each picture has, and the sum of its scaled histogram."""
    h = segment.histograms(_pixels(spark, d).select("video_id", "pos", "pixels"), "pixels")
    return h.select("video_id", "pos", F.size(F.filter("histogram", lambda x: x > 0)).alias("colours"), F.round(F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _cuts(spark, d):
    e = catalog.table(spark, d, "events")
    return e.select(F.col("user_id").alias("video_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), (F.col("value") / 100).alias("p"))


def k1(spark, d):
    return segment.scenes(_cuts(spark, d), 0.5)


def k2(spark, d):
    s = _cuts(spark, d).groupBy("video_id").agg(F.max("pos").cast("int").alias("end")).select("video_id", F.lit(0).alias("start"), "end")
    return segment.chunks(s, 6)


def k3(spark, d):
    f = catalog.frames(spark, d).withColumn("scene", F.floor(F.col("pos") / 20))
    return segment.select_frames(f, ["video_id", "scene"], "pos", "embedding", segment.cluster_keyframes)


def k4(spark, d):
    f = catalog.frames(spark, d)
    return segment.select_frames(f, ["video_id"], "pos", "embedding", lambda x: segment.distinct_in_order(x, 0.3, 10))


QUERIES = {
    "f1_f4_f5_f8_bm25": f8, "f2_f3_f7_phrases": f2, "f6_fuzzy_expansions": f6, "f9_list_tokens": f9, "f11_boosted_query": f_full, "f12_speech_search": f12, "f13_f14_snippets": f14, "f15_watermark_weights": f15,
    "x1_events": x1, "x2_x3_sub_queries": x2, "x5_strip_accents": x5, "x6_glued_parts": x6, "x7_math_notation": x7, "x8_repetition": x8, "x10_token_class": x10, "x12_foreign_lines": x12, "x11_x14_line_correction": x14,
    "x13_token_resolver": x13, "x15_suggestions": x15, "x17_accents_in_context": x17, "x18_real_word_flags": x18, "x19_token_guards": x19, "a6_document_frequency": a6, "a7_domain_vocabulary": a7,
    "a8_watermark_vocabulary": a8, "d11_bigrams": d11, "u3_line_dedupe": u3, "k1_scenes": k1, "k2_chunks": k2, "k3_cluster_keyframes": k3, "k5_keyframe_pipeline": k5, "k4_histograms": k4h, "x9_p12_p13_frame_normalisation": x9, "w6_token_context": w6, "k4_distinct_in_order": k4,
}

_WORDS = "list_filter(string_split_regex(trim(lower(text), ' '), '[\\s\\x0b]+'), lambda x: x <> '')"


def _tok(where="true", key="doc_id", table="documents", text="text", weight="1"):
    return (
        f"a AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS ts FROM {table} WHERE {where}), "
        "t AS (SELECT k, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM a), l AS (SELECT k, count(*) AS dl FROM t GROUP BY k), st AS (SELECT count(*) AS n, avg(dl) AS av FROM l), "
        f"p AS (SELECT t.k, term, count(*) * {weight} AS tf, list(pos ORDER BY pos) AS ps, dl FROM t JOIN l ON l.k = t.k GROUP BY t.k, term, dl), "
        "f AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
        "s AS (SELECT p.*, df, av, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) AS part FROM p JOIN f ON f.term = p.term CROSS JOIN st)"
    )


def _widths(terms):
    """Over columns q0.. of positions, the widths of all minimal intervals: for each end the latest start of all terms, of equal starts the first end."""
    names = list(dict.fromkeys(terms))
    moved = [f"list_transform(coalesce(q{names.index(t)}, []), lambda y: y - {i})" for i, t in enumerate(terms)]
    start = "least(" + ", ".join(f"list_max(list_filter({m}, lambda x: x <= e))" for m in moved) + ", 1000000000)"
    there = " AND ".join(f"e >= list_min({m})" for m in moved)
    pairs = f"list_transform(list_filter(list_distinct(flatten([{', '.join(moved)}])), lambda e: coalesce({there}, false)), lambda e: struct_pack(s := {start}, e := e))"
    return f"(SELECT list(w) FROM (SELECT min(x.e) - x.s AS w FROM (SELECT unnest({pairs}) AS x) GROUP BY x.s))"


def _slop(slop):
    """The phrase frequency of the column ws of widths."""
    return f"coalesce(list_sum(list_transform(list_filter(ws, lambda g: g <= {slop}), lambda g: 1.0 / (1 + g))), 0.0)"


def _matched(terms):
    names = list(dict.fromkeys(terms))
    weight = "CASE term " + " ".join(f"WHEN '{t}' THEN {terms.count(t)}" for t in names) + " END"
    cols = ", ".join(f"max(CASE WHEN term = '{t}' THEN ps END) AS q{i}" for i, t in enumerate(names))
    inside = ", ".join(f"'{t}'" for t in names)
    return f"m0 AS (SELECT k, any_value(dl) AS dl, any_value(av) AS av, count(*) AS matched, sum(idf * part * {weight}) AS bm25, sum(idf * {weight}) AS idfs, {cols} FROM s WHERE term IN ({inside}) GROUP BY k), m AS (SELECT *, {_widths(terms)} AS ws FROM m0)"


def _full(terms, name, top, **tok):
    names = list(dict.fromkeys(terms))
    n = len(names)
    values = ", ".join(f"('{t}')" for t in names)
    phrase = lambda s: f"idfs * {_slop(s)} * 2.2 / ({_slop(s)} + 1.2 * (0.25 + 0.75 * dl / av))"
    return f"""WITH {_tok(**tok)}, {_matched(terms)},
x AS (SELECT q, term FROM (SELECT q, f.term, row_number() OVER (PARTITION BY q ORDER BY damerau_levenshtein(f.term, q), df DESC, f.term) AS r FROM f JOIN (VALUES {values}) v(q) ON f.term[1:2] = q[1:2]
  WHERE damerau_levenshtein(f.term, q) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 5 THEN 1 ELSE 2 END) WHERE r <= 20),
z AS (SELECT k, sum(b) AS fz FROM (SELECT k, q, max(idf * part) AS b FROM s JOIN x ON x.term = s.term GROUP BY k, q) GROUP BY k),
r AS (SELECT m.k AS {name}, round(bm25 + 10 * {phrase(0)} + 6 * {phrase(3)} + {phrase(10)} + 1.5 * coalesce(fz, 0) + CASE WHEN matched = {n} THEN 4 * bm25 ELSE 0 END + CASE WHEN matched >= {max(1, int(n * 0.85))} THEN 2.5 * bm25 ELSE 0 END, 6) AS score
  FROM m LEFT JOIN z ON z.k = m.k WHERE matched >= {max(1, int(n * 0.5))})
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, {name}) AS rank FROM r) WHERE rank <= {top}"""


_N = len(set(TERMS))
_DF = "w AS (SELECT source, doc_id, lang, " + _WORDS + " AS ws FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM documents), df AS (SELECT token, count(DISTINCT source) AS df FROM (SELECT source, unnest(ws) AS token FROM w) GROUP BY token)"
_LINES = "l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
#: Letters of the tables beyond ASCII, and single bytes that stand for them where SQL counts edits in bytes.
_LETTERS, _LETTERS_AS = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿœæß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"
_ACC, _PLAIN = T.ACCENTED + T.ACCENTED.upper(), T.UNACCENTED + T.UNACCENTED.upper()

def _token_class():
    """The token classes in SQL; both regex engines read the same patterns."""
    num, loose, units, money = T.NUMBER, T.LOOSE, T.UNITS, T.CURRENCIES
    date, time, percent = r"^\d{1,2}[/\-.]\d{1,2}([/\-.]\d{2,4})?$", r"^\d{1,2}:\d{2}(:\d{2})?$", f"^{num}%$"
    date_l, time_l = rf"^({loose})[/\-.]({loose})(?:[/\-.]({loose}))?$", f"^({loose}):({loose})(?::({loose}))?$"
    measure, cash = rf"(?i)^{num}\s*(?:{units})$", rf"(?i)^{num}\s*(?:{money})$"
    measure_l, cash_l, percent_l = rf"(?i)^({loose})\s*({units})$", rf"(?i)^({loose})\s*({money})$", f"^({loose})(%)$"
    part = lambda pattern, i: f"regexp_extract(t, '{pattern}', {i})"
    fixed = lambda x: f"translate({x}, '{T.CONFUSABLE}', '{T.DIGITS}')"
    unit = lambda pattern: f"{fixed(part(pattern, 1))} || {part(pattern, 2)}"
    three = lambda pattern, sign: f"{fixed(part(pattern, 1))} || {sign} || {fixed(part(pattern, 2))} || CASE WHEN {part(pattern, 3)} <> '' THEN {sign} || {fixed(part(pattern, 3))} ELSE '' END"
    sign = "(CASE WHEN contains(t, '/') THEN '/' WHEN contains(t, '-') THEN '-' ELSE '.' END)"
    is_ = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    acronyms = ", ".join(f"'{a}'" for a in T.ACRONYMS)
    acronym = f"list_filter([{acronyms}], lambda a: upper(a) = upper(t))[1]"
    bare = "translate(t, '.- ', '')"
    loan = ", ".join(f"'{w}'" for w in T.LOANWORDS)
    cases = [
        (is_("t", date), "date", "t", "pass"), (is_("t", time), "time", "t", "pass"), (is_("t", date_l) + " AND " + is_(f"({three(date_l, sign)})", date), "date", three(date_l, sign), "correct"),
        (is_("t", time_l) + " AND " + is_(f"({three(time_l, chr(39) + ':' + chr(39))})", time), "time", three(time_l, "':'"), "correct"), (is_("t", percent), "percent", "t", "pass"), (is_("t", cash), "currency", "t", "pass"),
        (is_("t", percent_l) + " AND " + is_(f"({unit(percent_l)})", percent), "percent", unit(percent_l), "correct"), (is_("t", cash_l) + " AND " + is_(f"({unit(cash_l)})", cash), "currency", unit(cash_l), "correct"),
        (is_("t", measure), "measurement", "t", "pass"), (is_("t", measure_l) + " AND " + is_(f"({unit(measure_l)})", measure), "measurement", unit(measure_l), "correct"),
        (is_(bare, r"^(0|\+84)\d{9,10}$"), "phone", bare, "pass"), ("regexp_matches(t, '^[A-Z0-9]{4,}$') AND regexp_matches(t, '[0-9]')", "code", "t", "pass"), (f"lower(t) IN ({loan})", "loanword", "t", "pass"), (f"{acronym} IS NOT NULL", "acronym", acronym, "pass"),
    ]
    pick = "CASE " + " ".join(f"WHEN {c} THEN struct_pack(category := '{k}', corrected := {v}, action := '{a}')" for c, k, v, a in cases) + " END"
    golden = ", ".join(f"('{t}')" for t in GOLDEN)
    return f"WITH w AS (SELECT {_WORDS} AS ws FROM documents), u AS (SELECT unnest(ws) AS t FROM w UNION SELECT * FROM (VALUES {golden}) v(t)), c AS (SELECT t, {pick} AS c FROM (SELECT DISTINCT t FROM u)) SELECT t AS token, c.category AS category, c.corrected AS corrected, c.action AS action FROM c WHERE c IS NOT NULL"


_CTX = (
    "c AS (SELECT doc_id, i - 1 AS pos, ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS before, ws[i + 1] AS after FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)), "
    "b AS (SELECT before AS w1, token AS w2, count(*) AS n FROM c WHERE before IS NOT NULL GROUP BY 1, 2)"
)
_BEST = """
p AS (SELECT DISTINCT before, token, after FROM c WHERE before IS NOT NULL OR after IS NOT NULL),
e AS (SELECT p.*, k.word, coalesce(l.n, 0) + coalesce(r.n, 0) AS evidence, coalesce(x.n, 0) + coalesce(y.n, 0) AS other FROM p JOIN k ON k.token = p.token
 LEFT JOIN b l ON l.w1 = p.before AND l.w2 = p.token LEFT JOIN b r ON r.w1 = p.token AND r.w2 = p.after LEFT JOIN b x ON x.w1 = p.before AND x.w2 = k.word LEFT JOIN b y ON y.w1 = k.word AND y.w2 = p.after)
SELECT before, token, after, max(other) AS other, any_value(evidence) AS evidence FROM e GROUP BY before, token, after"""

ORACLE_SQL = {
    "x10_token_class": _token_class(),
    "x2_x3_sub_queries": """WITH q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark), p AS (SELECT item_id, list_filter(list_transform(list_prepend(q, string_split(q, ',')), lambda x: trim(x)), lambda x: x <> '') AS p FROM q),
u AS (SELECT item_id, unnest(p) AS x, unnest(range(0, len(p))) AS i FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(x) ORDER BY i) AS r FROM u)
SELECT item_id, string_agg(x, '|' ORDER BY i) AS parts, 'a dog and then a cat after rain, and sun, a dog ' || item_id || '|a dog|a cat|rain|sun|a dog ' || item_id AS connective FROM k WHERE r = 1 GROUP BY item_id""",
    "w6_token_context": f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), {_CTX} SELECT * FROM c",
    "x17_accents_in_context": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), {_CTX}, df AS (SELECT token, count(DISTINCT doc_id) AS df FROM c GROUP BY token),
d AS (SELECT token, translate(token, '{_ACC}', '{_PLAIN}') AS plain FROM df WHERE df >= greatest(2, ceil(0.0005 * (SELECT count(DISTINCT doc_id) FROM w)))), k AS (SELECT x.token, y.token AS word FROM d x JOIN d y ON x.plain = y.plain AND x.token <> y.token),
{_BEST} HAVING max(other) >= 2 AND max(other) >= (any_value(evidence) + 1) * 1.5""",
    "x18_real_word_flags": f"""WITH w AS (SELECT doc_id, lang, {_WORDS} AS ws FROM documents), {_CTX}, df AS (SELECT token, count(DISTINCT w.doc_id) AS df FROM c JOIN w ON w.doc_id = c.doc_id WHERE lang = 'en' GROUP BY token),
d AS (SELECT token, translate(token, '{_LETTERS}', '{_LETTERS_AS}') AS t FROM df WHERE df >= greatest(4, ceil(0.0005 * (SELECT count(DISTINCT doc_id) FROM w WHERE lang = 'en'))) AND regexp_matches(token, '^\\p{{L}}+$')),
s AS (SELECT w1 AS word FROM b WHERE n >= 15 UNION SELECT w2 FROM b WHERE n >= 15), k AS (SELECT x.token, y.token AS word FROM d x JOIN d y ON abs(length(x.token) - length(y.token)) <= 1 AND x.token <> y.token AND levenshtein(x.t, y.t) = 1 WHERE y.token IN (SELECT word FROM s)),
{_BEST} HAVING max(other) >= 30 AND max(other) >= (any_value(evidence) + 1) * 10.0""",
    "x19_token_guards": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT DISTINCT token FROM (SELECT unnest(ws) AS token FROM w)),
c AS (SELECT token, regexp_replace(token, '^[(),"'']+|[(),"'']+$', '', 'g') AS core, regexp_replace(upper(replace(token, 'ß', 'SS')), '^[(),"'']+|[(),"'']+$', '', 'g') AS up FROM t)
SELECT token, core, (regexp_matches(up, '^\\p{{L}}{{2,}}$') AND upper(up) = up) OR (regexp_matches(up, '\\p{{L}}') AND regexp_matches(up, '[0-9&.]')) AS risky FROM c""",
    "k1_scenes": """WITH e AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 100 AS p FROM events),
v AS (SELECT video_id, (count(*) - 1)::INT AS last, coalesce(list(pos::INT ORDER BY pos) FILTER (p > 0.5), []) AS cuts FROM e GROUP BY video_id),
f AS (SELECT video_id, last, CASE WHEN cuts[1] = 0 THEN cuts[2:] ELSE cuts END AS cuts0, cuts FROM v),
s AS (SELECT video_id, last, list_reduce(list_prepend(struct_pack(s := 0, a := []::STRUCT(s INT, e INT)[]), list_transform(cuts, lambda c: struct_pack(s := c, a := []::STRUCT(s INT, e INT)[]))),
 lambda acc, c: CASE WHEN c.s > acc.s THEN struct_pack(s := c.s + 1, a := list_append(acc.a, struct_pack(s := acc.s, e := c.s))) ELSE acc END) AS r FROM f),
t AS (SELECT video_id, last, CASE WHEN r.s <= last THEN list_append(r.a, struct_pack(s := r.s, e := last)) ELSE r.a END AS a FROM s),
u AS (SELECT video_id, unnest(CASE WHEN len(a) = 0 THEN [struct_pack(s := 0, e := last)] ELSE a END) AS x FROM t) SELECT video_id, x.s AS start, x.e AS "end" FROM u""",
    "f1_f4_f5_f8_bm25": f"WITH {_tok()}, {_matched(TERMS)} SELECT k AS doc_id, matched, round(bm25, 6) AS bm25, matched >= {max(1, int(_N * .5))} AS half, matched >= {max(1, int(_N * .85))} AS most, matched = {_N} AS all_terms FROM m",
    "f2_f3_f7_phrases": f"WITH {_tok()}, {_matched(['of', 'the'])} SELECT k AS doc_id, " + ", ".join(f"round({_slop(s)}, 6) AS slop{s}" for s in (0, 3, 10)) + " FROM m WHERE matched = 2",
    "f6_fuzzy_expansions": f"""WITH {_tok()} SELECT query_term, term FROM (SELECT q AS query_term, f.term, row_number() OVER (PARTITION BY q ORDER BY damerau_levenshtein(f.term, q), df DESC, f.term) AS r FROM f JOIN (VALUES ('thtion'), ('there'), ('an')) v(q) ON f.term[1:2] = q[1:2]
WHERE damerau_levenshtein(f.term, q) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 5 THEN 1 ELSE 2 END) WHERE r <= 20""",
    "f13_f14_snippets": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lower(strip_accents(coalesce(text, ''))) AS f FROM documents),
p AS (SELECT doc_id, q, string_split(f, q) AS ps FROM t CROSS JOIN (VALUES ('and the ereaan'), ('ereaan')) AS v(q)),
m AS (SELECT doc_id, a, a + length(q) AS b FROM (SELECT doc_id, q, unnest(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(q)))::BIGINT AS a FROM p)),
i AS (SELECT *, CASE WHEN a <= max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY a, b)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM i),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, g),
h AS (SELECT doc_id, min(a) AS a, arg_min(b, a) AS b FROM r GROUP BY doc_id),
e AS (SELECT h.doc_id, h.a, coalesce(max(r.b) FILTER (r.b - h.a <= 160), h.b) AS b FROM h JOIN r ON r.doc_id = h.doc_id GROUP BY h.doc_id, h.a, h.b),
s AS (SELECT t.*, length(text) AS n, least(length(text), coalesce(greatest(0, e.a - greatest(0, 160 - (e.b - e.a)) // 2), 0) + 160) AS stop FROM t LEFT JOIN e ON e.doc_id = t.doc_id),
u AS (SELECT *, greatest(0, stop - 160) AS start FROM s),
k AS (SELECT u.doc_id, greatest(r.a, start) AS a, least(r.b, stop) AS b FROM u JOIN r ON r.doc_id = u.doc_id WHERE greatest(r.a, start) < least(r.b, stop)),
l AS (SELECT k.doc_id, string_agg(text[coalesce(prev, start) + 1:a] || '[[' || text[a + 1:b] || ']]', '' ORDER BY a) AS x, max(b) AS seen FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM k) k JOIN u ON u.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT u.doc_id, coalesce(x, '') || text[coalesce(seen, start) + 1:stop] AS snippet, start > 0 AS cut_before, stop < n AS cut_after, x IS NOT NULL AS has_match FROM u LEFT JOIN l ON l.doc_id = u.doc_id""",
    "f9_list_tokens": f"""WITH {_LINES}, a AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS ts FROM l),
b AS (SELECT *, coalesce(sum(len(ts)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 * line_no AS s FROM a), t AS (SELECT doc_id, unnest(ts) AS term, s + unnest(range(0, len(ts))) AS pos FROM b)
SELECT doc_id, count(*) AS n, max(pos)::INT AS last, count(DISTINCT term) AS terms FROM t GROUP BY doc_id""",
    "f11_boosted_query": _full(TERMS, "doc_id", 50),
    "f15_watermark_weights": _full(["the", "of", "and"], "doc_id", 20, weight="CASE WHEN term = 'the' THEN 0.1 ELSE 1.0 END"),
    "f12_speech_search": _full(["of", "the"], "segment_id", 30, where="true", key="conv_id::VARCHAR || '-' || turn::INT", table="conversations"),
    "x1_events": """WITH q AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), ' '), '[.;]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS e FROM documents),
u AS (SELECT doc_id, unnest(e) AS p, unnest(range(0, len(e))) AS i FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(p) ORDER BY i) AS r FROM u), g AS (SELECT doc_id, count(*) AS events, string_agg(p, '|' ORDER BY i) AS joined FROM k WHERE r = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(events, 0)::INT AS events, coalesce(joined, '') AS joined FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "x5_strip_accents": f"SELECT doc_id, md5(translate(text, '{_ACC}', '{_PLAIN}')) AS plain_md5, length(text)::INT AS n FROM documents",
    "x7_math_notation": f"""WITH t AS (SELECT doc_id, translate(text, 'abcdefg', '⁰¹²₃₄₅ⁿ') AS t FROM documents)
SELECT doc_id, md5(translate(regexp_replace(t, '([{T.SUPERSCRIPTS}]+)', '^\\1', 'g'), '{T.SUPERSCRIPTS + T.SUBSCRIPTS}', '{T.SUPERSCRIPT_VALUES + T.SUBSCRIPT_VALUES}')) AS plain_md5 FROM t""",
    "x12_foreign_lines": f"""WITH {_LINES}, w AS (SELECT *, regexp_extract_all(line, '[A-Za-zÀ-ỹ]+') AS ws FROM l)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[{T.VIETNAMESE}]') THEN false WHEN regexp_matches(line, '{T.OTHER_SCRIPTS}') THEN true
ELSE len(ws) >= 4 AND len(list_filter(ws, lambda x: lower(x) IN ({', '.join(repr(w) for w in T.ENGLISH)}))) >= 2 END AS foreign_line FROM w""",
    "a6_document_frequency": f"WITH {_DF} SELECT token, df FROM df",
    "a7_domain_vocabulary": f"WITH {_DF} SELECT token, df FROM df CROSS JOIN n WHERE df >= greatest(3, ceil(0.5 * n))",
    "a8_watermark_vocabulary": f"""WITH {_DF}, en AS (SELECT token FROM (SELECT source, unnest(ws) AS token FROM w WHERE lang = 'en') GROUP BY token HAVING count(DISTINCT source) >= 15)
SELECT token, df FROM df CROSS JOIN n WHERE df >= greatest(5, round_even(0.3 * n, 0)) AND length(token) >= 2 AND token NOT IN ('mekong', 'thuy', 'quayphim', 'mat', '19', 'hit') AND token NOT IN (SELECT token FROM en)""",
    "d11_bigrams": f"WITH w AS (SELECT {_WORDS} AS ws FROM documents), b AS (SELECT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT w1, w2, count(*) AS n FROM b GROUP BY w1, w2",
    "u3_line_dedupe": f"WITH {_LINES}, k AS (SELECT *, trim(line, ' ') AS key FROM l) SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS r FROM k) WHERE r = 1 OR key = ''",
    "k2_chunks": """WITH s AS (SELECT user_id AS video_id, (count(*) - 1)::INT AS e FROM events GROUP BY user_id), c AS (SELECT video_id, e, unnest(range(0, e + 1, 7))::INT AS s FROM s)
SELECT video_id, s AS start, least(s + 6, e)::INT AS "end" FROM c""",
}
