"""Quality rules: base word rules, then cross-document line frequency per host.

Lines are normalised and hashed; a line that occurs in too many distinct documents of one host is removed, and a
document of which too little remains is rejected. DataFrame functions only. Texts are read once for measures and line
keys, which are written as a narrow table; counting and removing work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import BLANKS, let, materialised, salted_join, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed when more distinct documents of its host hold it, however large the host is.
MAX_DOCS = 25
#: A document is depleted when less than this share of its words remains.
MIN_WORDS_LEFT = 0.3

#: Low bits of a window's sort key that hold its position; longer texts take a wider key.
POSITION_BITS = 17


def _window_keys(w: Column, size: int) -> Column:
    """Per window a long that sorts by the words' hash, then by position."""
    low = (1 << POSITION_BITS) - 1
    n = F.size(w) - size + 1
    # Chained over neighbours, which is cheaper in a lambda than reading several elements by index.
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    chained = F.slice(hashed, F.lit(1), n)
    for k in range(1, size):
        chained = F.zip_with(chained, F.slice(hashed, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))
    return F.transform(chained, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))


def _repeated_starts(w: Column, s: Column, size: int) -> Column:
    """Positions of windows that have an equal neighbour in the sorted keys ``s``; the words themselves decide."""
    at = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    def same(x: Column, k: Column) -> Column:
        y = F.coalesce(F.get(s, k), x.bitwiseXOR(F.lit(-1)))
        alike = [F.get(w, at(x) + j) == F.get(w, at(y) + j) for j in range(size)]
        out = F.shiftright(x.bitwiseXOR(y), POSITION_BITS) == 0
        for one in alike:
            out = out & one
        return out

    return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), at)


def _repeated_starts_long(w: Column, size: int) -> Column:
    """The same for texts of any length, by wider keys."""
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(s, k)
            out = y["h"] == x["h"]
            for j in range(size):
                out = out & (F.get(w, x["i"] + j) == F.get(w, y["i"] + j))
            return F.coalesce(out, F.lit(False))

        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    return let(F.sort_array(keys), repeated)


def _covered(starts: Column, size: int) -> Column:
    """Number of positions in windows of ``size`` that begin at ``starts``."""
    first = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"))
    return F.aggregate(F.sort_array(starts), first, step, lambda a: a["n"])


def parsed(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, host, two hashes of doc_id, source and text, the hash of the text, ``m``: the struct of base measures,
    and ``lines``: key and words of each line, null where it has no words. Null counts as an empty text.

    n_repeat_words: words in ``size``-word windows that occur at least twice in the text.
    """
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    whole = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    blanks = F.length(F.regexp_replace(whole, r"[^\x20\x09-\x0D]+", ""))
    w, n = F.col("_w"), F.size("_w")
    short = n.between(size + 1, 1 << POSITION_BITS)
    starts = F.when(n <= size, F.array().cast("array<int>")).when(short, _repeated_starts(w, F.col("_s"), size)).otherwise(_repeated_starts_long(w, size))
    measures = [
        n.cast("long").alias("n_words"),
        (F.length(whole) - blanks).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(starts, size).cast("long").alias("n_repeat_words"),
    ]
    rows = docs.select("doc_id", F.coalesce(source, F.lit("\x00")).alias("host"), text.alias("_t"), *_identity(docs))
    rows = rows.withColumns({"_w": words(F.col("_t")), "_lines": lines, "text_hash": F.xxhash64("_t")})
    rows = rows.withColumn("_s", F.when(short, F.sort_array(_window_keys(w, size))))
    # A generated column: filters on it are not pushed below, where they would repeat the measures for each use.
    return rows.withColumn("m", F.explode(F.array(F.struct(*measures)))).select("doc_id", "host", "h1", "h2", "text_hash", "m", line_keys(F.col("_t")).alias("lines"))


def _identity(docs: DataFrame) -> list[Column]:
    """Two hashes of doc_id, source and text; rows equal in these get equal verdicts."""
    named = [F.col("doc_id"), F.col("source").cast("string"), F.col("text").cast("string")]
    known = [F.coalesce(c.isNull(), F.lit(True)) for c in named]
    return [F.xxhash64(*named, *known).alias("h1"), F.xxhash64(F.lit(1), *reversed(named), *known).alias("h2")]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def line_keys(text: Column) -> Column:
    """Per line the hash of its normal form (lower case, digits as 0, blanks as one space) and its number of words;
    null for lines without words. Lines of any length have a key."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")

    def key(norm: Column) -> Column:
        n = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
        return F.when(norm != "", F.struct(F.xxhash64(norm).alias("key"), n.cast("int").alias("n")))

    return F.transform(F.split(plain, "\n"), lambda x: let(F.btrim(x, F.lit(" ")), key))


def frequent_lines(base: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, key of the lines that more than ``max_docs`` distinct documents of the host hold; ``base``: parsed rows.

    Rows with equal texts are one document: else a page that was fetched often would make all its own lines frequent,
    and no copy of it would be left for the deduplication that follows.
    """
    texts = base.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: x["key"]))
    return texts.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "key")


def judged(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Parsed rows of ``docs`` with positions and words of removed lines (null without any), base_failed and kept."""
    base = materialised(parsed(docs).withColumn("row", F.monotonically_increasing_id()), "line-keys")
    lines = base.select("row", "host", F.posexplode("lines").alias("at", "x")).where("x IS NOT NULL").select("row", "host", "at", F.col("x.key").alias("key"), F.col("x.n").alias("n"))
    hit = salted_join(lines, frequent_lines(base, max_docs), ["host", "key"], F.struct("row", "at"), salts=8)
    gone = hit.groupBy("row").agg(F.collect_list("at").alias("removed"), F.sum("n").alias("n_removed_words"))
    n, failed = F.col("m.n_words"), base_failed(F.col("m"))
    depleted = n - F.coalesce("n_removed_words", F.lit(0)) < MIN_WORDS_LEFT * n
    return base.join(gone, "row", "left").withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, source; other columns are ignored).

    Null and empty texts have no words and fail the base rules. A null source is a host of its own. Rows that
    repeat doc_id, source and text repeat the verdict. Very long texts are measured whole. An empty table gives an
    empty result.
    """
    return judged(docs, max_docs).select("doc_id", "m.*", "base_failed", "kept", F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The kept documents, with the frequent lines taken out of their texts; the columns of ``docs``, whatever their
    names; n_chars, where there is one, follows the text.

    Nulls, empty texts and repeats are judged as in ``quality_rules``: null and empty texts go, repeated rows stay
    repeated, null ids stay. An empty table gives an empty result.
    """
    verdict = judged(docs, max_docs).where("kept").groupBy("h1", "h2").agg(F.first("removed").alias("removed"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_identity(docs))
    kept = salted_join(rows, verdict, ["h1", "h2"], F.monotonically_increasing_id(), salts=4)
    lines = F.split("doc.text", "\n")
    # Set operations on positions, which stay linear in the lines of a long text.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(let(lines, lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")))
    kept = kept.withColumn("doc", F.col("doc").withField("text", text))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("doc", F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)))
    return kept.select("doc.*")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
    SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3))),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM win WHERE n > 1) GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, host, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid),
ln AS (
  SELECT rid, host, t, k, len(string_split(k, ' ')) AS n FROM (
    SELECT rid, host, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k
    FROM (SELECT rid, host, t, unnest(ls) AS x FROM d))
  WHERE k <> ''),
freq AS (SELECT host, k FROM ln GROUP BY host, k HAVING count(DISTINCT t) > 25),
gone AS (SELECT rid, sum(n)::BIGINT AS n FROM ln JOIN freq USING (host, k) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - coalesce(gone.n, 0) < 0.3::DOUBLE * n_words) AS kept,
  coalesce(gone.n, 0)::BIGINT AS n_removed_words
FROM base LEFT JOIN gone ON base.rid = gone.rid
"""
