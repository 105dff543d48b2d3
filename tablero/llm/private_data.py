r"""Personal data: base patterns, and terms that reveal the entities they name.

Base spans are emails, IP addresses, card and phone numbers, leftmost and non-overlapping per
kind, in code points. Their positions follow from the pieces between the matches.

Every base span is an entity. Its context is the text between it and the next matches of its
kind in its line, and the distinct lines of the corpus are the sample that probabilities are
estimated on, so copies prove nothing twice. With n(.) the number of distinct lines of N, and
``DISCOUNT`` of a line taken off what is seen together, as a single meeting may be chance, a
term t discloses entity e by

    PMI(e, t) / IC(e) = log(N (n(e, t) - DISCOUNT) / (n(e) n(t))) / log(N / n(e)),

which nears 1 when e is on all the term's lines: the term then reveals all there is to know.
Terms at or above ``disclosure`` are sanitised in every text, also where the entity itself is
not named: numbers are generalised, other terms removed.

Nulls: a null text has no spans. Repeated rows count as one sample and are each returned. Ties
cannot arise: every match and every term at the threshold counts. Very long texts are taken
whole; the words of one are numbered in one task, and many matches in one text cost their
number to the power 3/2. Empty tables give empty results. Other columns are ignored. Built-in
expressions only; all repeated groups are possessive, so long texts neither backtrack nor
recurse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablero.llm.shared import BLANK_RUN, LOWER, UPPER, Scratch, passing, table

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
DISCOUNT = 0.5
DISCLOSURE = 0.9
# 64-bit words of a filter that spares most other terms the shuffle, whatever there is to find.
FILTER = 1 << 14
# The same for lines and texts.
TEXTS = 1 << 16
# 64-bit words of the places that a term's lines fall to.
PLACES = 4

_LOCAL = "[A-Za-z0-9._%+-]"
# A run of these is entered at its start or where the last match ended, never again inside.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"
# A text without this cannot match.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    def value(k: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - k, F.lit(1))) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
                       lambda a, k: a + value(k))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Leading zeros apart, a part of more than three digits is too large.
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | (
            (F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(value)) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, value), ordered by kind, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", *[
        column for kind in KINDS for column in (
            F.when(HINTS[kind](whole), F.split(whole, PATTERNS[kind], -1)).alias(f"_b_{kind}"),
            F.when(HINTS[kind](whole), F.regexp_extract_all(
                whole, F.lit(PATTERNS[kind]), F.lit(0))).alias(f"_m_{kind}"),
        )
    ])

    # Appending copies a list, so matches are placed in short stretches: the starts of the
    # stretches first, then the matches of each. What is used more than once is a column.
    df = df.select("*", *[F.zip_with(
        F.slice(f"_b_{kind}", F.lit(1), F.size(f"_m_{kind}")), f"_m_{kind}", lambda b, m: F.struct(
            F.length(b).alias("b"), F.length(m).alias("m"), m.alias("value"))).alias(f"_z_{kind}")
        for kind in KINDS])

    def stretches(found: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(found))).cast("int")
        return F.when(F.size(found) > 0, F.transform(
            F.sequence(F.lit(1), F.size(found), step), lambda i: F.slice(found, i, step)))

    df = df.select("*", *[stretches(F.col(f"_z_{kind}")).alias(f"_s_{kind}") for kind in KINDS])

    def length(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda a, s: a + s["b"] + s["m"])

    def placed(kind: str) -> Column:
        none, parts = F.array().cast(_SPANS), F.col(f"_s_{kind}")
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(F.transform(parts, length), begin, lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

        def spans(some: Column, at: Column) -> Column:
            return F.aggregate(some, F.struct(at.alias("at"), none.alias("out")), lambda a, s: F.struct(
                (a["at"] + s["b"] + s["m"]).alias("at"), F.concat(a["out"], F.array(F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"), (a["at"] + s["b"]).alias("start"),
                    (a["at"] + s["b"] + s["m"]).alias("end"), s["value"].alias("value"),
                ))).alias("out")))["out"]

        whole = F.flatten(F.zip_with(parts, starts, spans))
        return F.coalesce(F.filter(whole, lambda s: _valid(kind, s["value"])), none)

    return df.select(*docs.columns, F.concat(*map(placed, KINDS)).alias("spans"))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _term(word: Column) -> Column:
    """A word as a term: lower case, without marks at its ends; empty for one or two letters."""
    bare = F.regexp_replace(_lowered(word), r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    return F.when(F.length(bare) > 2, bare).otherwise("")


def _entity(kind: Column, value: Column) -> Column:
    same = F.when(kind < 2, _lowered(value)).otherwise(_digits(value))
    return F.concat(kind.cast("string"), F.lit(":"), same)


def _lines(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """A row per line: the columns, ``line`` and its digest ``d``."""
    return docs.select(*columns, F.explode(F.split(F.col(text), "\n", -1)).alias("line")).withColumn(
        "d", F.unhex(F.md5("line")))


def contexts(lines: DataFrame) -> DataFrame:
    """(entity, d, left, right): each entity in each distinct line, and what is around it."""
    hit = F.lit(False)
    for kind in KINDS:
        hit = hit | HINTS[kind](F.col("line"))
    some = lines.where(hit).select("line", "d").dropDuplicates(["d"])
    parts = []
    for kind_id, kind in enumerate(KINDS):
        found = some.select("d", F.split("line", PATTERNS[kind], -1).alias("b"), F.regexp_extract_all(
            "line", F.lit(PATTERNS[kind]), F.lit(0)).alias("m")).where(F.size("m") > 0)
        parts.append(found.select("d", F.inline(F.arrays_zip(
            F.col("m").alias("value"), F.slice("b", F.lit(1), F.size("m")).alias("left"),
            F.slice("b", F.lit(2), F.size("m")).alias("right")))).where(
            _valid(kind, F.col("value"))).select(
            _entity(F.lit(kind_id), F.col("value")).alias("entity"), "d", "left", "right"))
    return reduce(DataFrame.unionByName, parts)


def _terms(*texts: str) -> Column:
    """The distinct terms of some texts."""
    words = F.concat(*[F.split(t, BLANK_RUN, -1) for t in texts])
    return F.filter(F.array_distinct(F.transform(words, _term)), lambda t: t != "")


def _bits(terms: DataFrame) -> Column:
    """A filter over column ``term`` that passes all the given terms and few others."""
    place = F.pmod(F.xxhash64("term"), F.lit(64 * FILTER))
    rows = terms.select(place.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64).cast("int")))
        .alias("b")).collect()  # FILTER rows at most
    words = [0] * FILTER
    for row in rows:
        words[row["w"]] = row["b"]
    literal = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    held = F.get(literal, F.floor(place / 64).cast("int"))
    return F.getbit(held, (place % 64).cast("int")) == 1


def disclosing(docs: DataFrame, scratch: Scratch, text: str = "text",
               disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) at or above the threshold, and (d, term): the lines, by their
    digest, that hold such a term."""
    lines = _lines(docs, text)
    near = scratch.write(contexts(lines), "contexts")
    by_line = near.select("entity", "d", F.explode(_terms("left", "right")).alias("term")).distinct()
    entities = near.groupBy("entity").agg(F.count_distinct("d").alias("n_e"))
    n = F.lit(float(max(lines.select("d").distinct().count(), 1)))

    def revealed(n_t: str) -> Column:
        return F.log(n * (F.col("n_et") - DISCOUNT) / (F.col("n_e") * F.col(n_t))) / F.log(
            n / F.col("n_e"))

    # The entities' own lines already bound how rare a term can be: most words end here, and
    # the corpus is counted for the others only.
    least = by_line.select("term", "d").distinct().groupBy(F.col("term").alias("_t")).agg(
        F.count(F.lit(1)).alias("least"))
    pairs = by_line.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).join(
        entities, "entity").where(F.col("n_e") < n)
    pairs = scratch.write(
        pairs.join(least, F.col("term") == F.col("_t")).where(revealed("least") >= disclosure)
        .drop("_t", "least"), "pairs")
    wanted = scratch.write(pairs.select("term").distinct(), "wanted")
    every = lines.select("d", F.explode(_terms("line")).alias("term"))
    # Different places of a term's lines bound their number from below, and are gathered before
    # the shuffle: frequent terms end here, and of the others each line is counted.
    place = F.pmod(F.xxhash64("d"), F.lit(64 * PLACES))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    shown = every.where(_bits(wanted)).groupBy(F.col("term").alias("_t")).agg(*[
        F.bit_or(F.when(F.floor(place / 64) == k, bit).otherwise(F.lit(0).cast("long")))
        .alias(f"_m{k}") for k in range(PLACES)]).select("_t", reduce(
            Column.__add__, [F.bit_count(f"_m{k}") for k in range(PLACES)]).alias("shown"))
    pairs = scratch.write(
        pairs.join(shown, F.col("term") == F.col("_t")).where(revealed("shown") >= disclosure)
        .drop("_t", "shown"), "likely")
    wanted = scratch.write(pairs.select("term").distinct(), "rare")
    some = every.where(_bits(wanted))
    held = scratch.write(some.join(wanted, "term", "left_semi").distinct(), "held")
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    found = scratch.write(
        pairs.join(counts, "term").where(revealed("n_t") >= disclosure)
        .select("entity", "term", revealed("n_t").alias("disclosure")), "found")
    terms = found.select("term").distinct()
    return found, scratch.write(held.join(terms, "term", "left_semi").select("d", "term"), "hits")


def sanitise(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """Adds ``spans``: the base ones, then those of disclosing terms, kind ``len(KINDS)``.

    A text's spans depend on the text alone, so added ones are found once per distinct text.
    A column ``spans`` is replaced.
    """
    scratch = Scratch(docs.sparkSession, "private-data")
    digest = F.unhex(F.md5(F.col(text)))
    _, hits = disclosing(docs, scratch, text, disclosure)
    # The terms of each text, by its lines. Of lines and texts only those with a term, and few
    # others, are shuffled.
    hidden = passing(_lines(docs, text, digest.alias("_id")).select("_id", "d"), "d",
                     hits.select("d"), TEXTS).join(
        hits, "d").select("_id", "term").distinct().groupBy("_id").agg(
        F.collect_set("term").alias("_terms"))
    hidden = scratch.write(hidden, "hidden").select(F.col("_id").alias("_i"), "_terms")
    texts = passing(docs.select(digest.alias("_id"), F.col(text).alias("_text")), "_id",
                    hidden.select("_i"), TEXTS).join(
        hidden, F.col("_id") == F.col("_i")).dropDuplicates(["_id"])
    # Words, then terms: a word is hit if its term is also one of the latter.
    none = F.lit(None).cast("string")
    items = F.concat(
        F.transform(F.arrays_zip(
            F.split("_text", BLANK_RUN, -1).alias("word"),
            F.regexp_extract_all("_text", F.lit(BLANK_RUN), F.lit(0)).alias("gap"),
        ), lambda w: F.struct(w["word"].alias("word"), w["gap"].alias("gap"), none.alias("term"))),
        F.transform("_terms", lambda t: F.struct(
            none.alias("word"), none.alias("gap"), t.alias("term"))))
    word = F.col("_w.word")
    words = texts.select("_id", F.posexplode(items).alias("_k", "_w")).select(
        "_id", "_k", (F.length(word) + F.coalesce(F.length("_w.gap"), F.lit(0))).alias("_size"),
        word.alias("_word"), F.coalesce("_w.term", _term(word)).alias("_term"))
    wanted = F.max(F.col("_word").isNull()).over(Window.partitionBy("_id", "_term"))
    words = words.withColumn("_wanted", wanted).where("_word is not null").select(
        "_id", "_k", "_size", F.when(F.col("_wanted"), F.struct(
            F.col("_term").alias("term"), F.col("_word").alias("word"))).alias("_hit"))
    before = Window.partitionBy("_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.instr(_lowered(F.col("_hit.word")), F.col("_hit.term")) - 1
    start = (F.coalesce(F.sum("_size").over(before), F.lit(0)) + lead).cast("int")
    terms = words.withColumn("start", start).where("_hit is not null").select(
        "_id", F.lit(len(KINDS)).alias("kind"), "start",
        (F.col("start") + F.length("_hit.term")).alias("end"),
        F.substring("_hit.word", lead + 1, F.length("_hit.term")).alias("value"))
    others = with_spans(texts.select("_id", "_text"), "_text").select("_id", F.inline("spans"))
    # A term is clear if no base span that begins before it ends in or after it, nor any begins
    # inside it.
    # Both are running values, so many spans in one text cost their number only.
    earlier = Window.partitionBy("_id").orderBy("start", "kind").rowsBetween(
        Window.unboundedPreceding, -1)
    later = Window.partitionBy("_id").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, -1)
    is_base = F.col("kind") < len(KINDS)
    reached = F.max(F.when(is_base, F.col("end"))).over(earlier)
    following = F.min(F.when(is_base, F.col("start"))).over(later)
    clear = terms.unionByName(others).select("*", reached.alias("_r"), following.alias("_f")).where(
        ~is_base & (F.coalesce("_r", F.lit(0)) <= F.col("start"))
        & (F.coalesce("_f", F.col("end")) >= F.col("end")))
    added = scratch.write(clear.groupBy(F.col("_id").alias("_i")).agg(F.sort_array(F.collect_list(
        F.struct("kind", "start", "end", "value"))).alias("_added")), "added")
    # The row in one column: whatever its columns are called, they clash with nothing here.
    base = with_spans(docs.select(
        F.struct(*[c for c in docs.columns if c != "spans"]).alias("_row"),
        F.col(text).alias("_text"), digest.alias("_id")), "_text")
    return base.join(added, F.col("_id") == F.col("_i"), "left").select(
        "_row.*", F.concat("spans", F.coalesce("_added", F.array().cast(_SPANS))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced: kinds by their name, numbers generalised, terms cut.

    Of overlapping base spans the first by position, then by kind, is replaced.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["value"].alias("value"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        mark = F.when(s["kind"] < len(KINDS), F.get(names, s["kind"])).when(
            s["value"].rlike(r"^\p{N}+$"), "[NUMBER]").otherwise("[TERM]")
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct(
            s["end"].alias("at"), F.concat(a["out"], gap, mark).alias("out"))).otherwise(a)

    done = F.aggregate(by_place, state, put)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def _listed(spans: Column, names: list[str]) -> Column:
    listed = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(listed, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op7_private_data``: counts, base digest and all spans of every document."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    out = sanitise(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return out.select(
        "doc_id",
        *[F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == kind_id), False))
          .cast("long").alias(f"n_{KINDS[kind_id]}") for kind_id in range(len(KINDS))],
        F.sha2(_listed(base, KINDS), 256).alias("base_sha256"),
        _listed(F.col("spans"), [*KINDS, TERM]).alias("spans"),
    )


def sql() -> str:
    """The same rows in DuckDB, by the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = f"""(SELECT sum(CASE WHEN k % 2 = 0 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)
      FROM (SELECT k, substr(reverse({digits}), (k + 1)::BIGINT, 1)::INT AS v
            FROM (SELECT unnest(range(0, length({digits}))) AS k)))"""
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(value, '.'), lambda p: p::HUGEINT > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    raw = "\n  UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, i, m[i] AS value, b[i] AS gap FROM (SELECT doc_id, m, b,"
        f" unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id,"
        f" regexp_extract_all(text, '{plain[kind]}') AS m,"
        f" regexp_split_to_array(text, '{plain[kind]}') AS b FROM d))"
        for k, kind in enumerate(KINDS))
    near = "\n  UNION ALL ".join(
        f"SELECT line, {k} AS kind, m[i] AS value, b[i] AS l, b[i + 1] AS r FROM (SELECT line, m, b,"
        f" unnest(range(1, len(m) + 1)) AS i FROM (SELECT line,"
        f" regexp_extract_all(line, '{plain[kind]}') AS m,"
        f" regexp_split_to_array(line, '{plain[kind]}') AS b FROM lines))"
        for k, kind in enumerate(KINDS))
    checks = " ".join(f"WHEN {k} THEN {valid[kind]}" for k, kind in enumerate(KINDS))
    names = "['email', 'ip', 'card', 'phone', 'term']"
    joined = (f"string_agg(({names})[kind + 1] || ':' || s || ':' || e, ','"
              " ORDER BY kind, s)")
    bare = r"regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
    blank = BLANK_RUN
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    term = f"(CASE WHEN length({bare}) > 2 THEN {bare} ELSE '' END)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({raw}),
ends AS (
  SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e
  FROM raw),
base AS (
  SELECT doc_id, kind, (e - length(value))::BIGINT AS s, e::BIGINT AS e FROM ends WHERE CASE kind {checks} END),
lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents),
near AS ({near}),
con AS (
  SELECT line, l, r, kind || ':' || CASE WHEN kind < 2 THEN {low.format('value')}
    ELSE {digits} END AS entity
  FROM near WHERE CASE kind {checks} END),
ne AS (SELECT entity, count(DISTINCT line) AS n_e FROM con GROUP BY entity),
net AS (
  SELECT entity, term, count(*) AS n_et FROM (
    SELECT DISTINCT entity, line, unnest(list_transform(list_concat(
      regexp_split_to_array({low.format('l')}, '{blank}'),
      regexp_split_to_array({low.format('r')}, '{blank}')), lambda x: {term})) AS term
    FROM con)
  WHERE term <> '' GROUP BY entity, term),
total AS (SELECT count(*)::DOUBLE AS n FROM lines),
held AS (
  SELECT line, term FROM (
    SELECT line, unnest(list_distinct(list_transform(
      regexp_split_to_array({low.format('line')}, '{blank}'), lambda x: {term}))) AS term
    FROM lines)
  WHERE term IN (SELECT term FROM net)),
nt AS (SELECT term, count(*) AS n_t FROM held GROUP BY term),
found AS (
  SELECT DISTINCT term FROM net JOIN ne USING (entity) JOIN nt USING (term), total WHERE n_e < n
  AND ln(n * (n_et - {DISCOUNT}) / (n_e * n_t)) / ln(n / n_e) >= {DISCLOSURE}),
hid AS (
  SELECT DISTINCT doc_id, term
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) JOIN held USING (line)
  WHERE term IN (SELECT term FROM found)),
w AS (
  SELECT doc_id, k, ws[k] AS word, gaps[k] AS gap FROM (
    SELECT doc_id, ws, gaps, unnest(range(1, len(ws) + 1)) AS k FROM (
      SELECT doc_id, regexp_split_to_array(text, '{blank}') AS ws,
        regexp_extract_all(text, '{blank}') AS gaps
      FROM d WHERE doc_id IN (SELECT doc_id FROM hid)))),
placed AS (
  SELECT doc_id, word, {low.format('word')} AS x, sum(length(word) + coalesce(length(gap), 0))
    OVER (PARTITION BY doc_id ORDER BY k) - length(word) - coalesce(length(gap), 0) AS o
  FROM w),
terms AS (
  SELECT doc_id, 4 AS kind, (o + instr(x, term) - 1)::BIGINT AS s,
    (o + instr(x, term) - 1 + length(term))::BIGINT AS e
  FROM (SELECT doc_id, o, x, {term} AS term FROM placed)
  JOIN hid USING (doc_id, term)),
added AS (
  SELECT * FROM terms t WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.e AND b.e > t.s)),
spans AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT * FROM added),
rows AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{kind}"
                            for k, kind in enumerate(KINDS))},
    sha256(coalesce({joined} FILTER (kind < 4), '')) AS base_sha256, {joined} AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN rows USING (doc_id)"""
