"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are found by patterns (addresses, networks, cards, telephones).  Each value found is a protected entity.  The words of the texts that
mention it are candidate terms, wherever they stand; from document frequencies over the whole corpus,

    PMI(term, entity) = log2(N * df(term, entity) / (df(term) * df(entity))),     IC(entity) = log2(N / df(entity)),

and PMI / IC is the share of the entity's information that the term discloses: 1 where the term occurs only in texts with the
entity.  Frequencies count documents, copies included.  Terms seen with an entity in at least ``min_support`` different texts (fewer are no evidence: every word that occurs once would disclose all of its
text) are removed at ``remove_at`` and generalised to their shape at ``generalise_at``, at every place in every text; both add spans of the kind ``term``.

Entities that occur in the same texts are one class, and so are terms: frequencies of pairs are counted between classes, so a text
with many of both makes few pairs.  Candidate terms touch no match of a base pattern.

Positions come from splitting at the matches: the lengths of the parts between matches and of the matches add up to code-point
offsets, in a window over the matches of one text.  Patterns are written possessively and anchored to the start of a run, which finds the same leftmost
matches in linear time.  So a text takes time in proportion to its length and matches (sorting aside), and windows spill.

Defined cases: a null text counts as empty and has no spans; equal rows get equal spans; rows that repeat an id stay rows of their own; copies of a text
are one different text; an empty table yields no rows; other columns, whatever their names, pass by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.support import free_name, let, materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"

# The base patterns, each equal in matches to the plain form in the comment.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [..]+@[..]+(\.[..]+)+
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # [0-9]([\x20-]?[0-9])+ of 14 digits or more
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]++"
MARK = "\ue000"  # stands for a match
CHUNK = 512  # code points of the parts of a text that is read at many places
SECTION = 128 * CHUNK


@dataclass(frozen=True)
class DisclosureRules:
    min_support: int = 3  # different texts that hold both the term and the entity
    generalise_at: float = 0.90
    remove_at: float = 0.99
    broadcast_bytes: int = 16 << 20  # a small side is broadcast up to so many bytes, after they are summed


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<0: length of the part before, 1: match>> of the leftmost non-overlapping matches, and at last the length of the rest with null."""
    return F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda part: F.length(part)), F.regexp_extract_all(text, F.lit(pattern), 0))


def _placed(matches: DataFrame, *key: str) -> DataFrame:
    """``matches`` (key, at, m), exploded, with start and end in code points and value instead."""
    order = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = matches.where(F.col("m")["1"].isNotNull()).withColumn("value", F.col("m")["1"]).withColumn("end", F.sum(F.col("m")["0"] + F.length("value")).over(order).cast("int"))
    return rows.withColumn("start", F.col("end") - F.length("value")).drop("m", "at")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value have a right check digit."""

    def holds(digits: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0

    return let(_digits(value), holds)


def _small_parts(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _clear_terms(text: Column) -> Column:
    """The different words of a text, in lower case, that touch no match of a base pattern."""
    marked = F.translate(text, MARK, " ")
    for p in PATTERNS.values():
        marked = F.regexp_replace(marked, p, MARK)
    cut = F.regexp_replace(F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]*+{MARK}", MARK), rf"{MARK}++[\p{{L}}\p{{N}}]*+", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(cut, F.lit(WORD), 0), lambda w: F.lower(w)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, version, terms) of each row, and (row, version, start, rank, end, kind, value) of each base span; both materialised without texts.

    ``row`` tells rows apart, ``version`` is a hash of the text; texts without a match have no terms.  Texts without a match of a kind cost one search.
    """
    body = F.col("body")
    possible = {"email": body.contains("@"), "phone": body.contains("+")}
    found = [F.when(possible.get(k, body.rlike(p)), _matches(body, p)).alias(k) for k, p in PATTERNS.items()]
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(text).alias("body")).select("doc_id", "body", F.xxhash64("body").alias("version"), *found)
    rows = rows.withColumn("terms", F.when(reduce(Column.__or__, [F.coalesce(F.size(k) > 1, F.lit(False)) for k in PATTERNS]), _clear_terms(F.col("body")))).drop("body")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    each = [rows.select("row", "version", F.lit(rank).alias("rank"), F.posexplode(kind).alias("at", "m")) for rank, kind in enumerate(PATTERNS)]
    spans = _placed(reduce(DataFrame.unionByName, each), "row", "rank", "version")
    holds = reduce(lambda c, k: c.when(F.col("rank") == KINDS.index(k), _HOLDS[k](F.col("value"))), PATTERNS, F.when(F.lit(False), True))
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    spans = materialize(spans.where(holds).select("row", "version", "start", "rank", "end", named.alias("kind"), "value"), "pii-spans")
    return rows.select("row", "doc_id", "version", "terms"), spans


def _entity() -> Column:
    """The same number for the same value of a span, however it is written."""
    kind, value = F.col("kind"), F.col("value")
    return F.xxhash64("kind", F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value)))


def gathered(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct<state, out> of a walk over an array: ``step(state, item)`` gives the next state and an array<``kind``> to add to ``out``.

    Appending copies an array, so results are gathered in blocks of about the square root of their number.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def walk(state: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, found = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["out"], found).alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), one)

    def blocks(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), size - 1), lambda c: F.slice(xs, c * size + 1, size))

    def outer(acc: Column, part: Column) -> Column:
        return let(walk(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    whole = F.aggregate(let(items, blocks), F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), outer)
    return let(whole, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))


def clear_words(text: Column, spans: Column) -> Column:
    """array<struct<start, end, value>> of the words of a text that touch no span (start, end, ...).

    Words and spans are walked together by their starts: a word is out if a span before it reaches into it or the next span begins inside it.
    """
    kind = "struct<start:int,end:int,value:string>"
    item = lambda x, word, value: F.struct(x["start"].alias("start"), F.lit(word).alias("word"), x["end"].alias("end"), value.alias("value"))
    none = F.expr(f"cast(array() as array<{kind}>)")

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["0"]
        end = begin + F.length(x["1"])
        found = F.struct(begin.alias("start"), end.alias("end"), x["1"].alias("value"))
        return F.coalesce(end, at), F.when(x["1"].isNull(), none).otherwise(F.array(found))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        top, held = state["top"], state["held"]
        this = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
        after_span = F.struct(F.greatest(top, x["end"]).alias("top"), F.when(held["end"] <= x["start"], held).alias("held"))
        after_word = F.struct(top.alias("top"), F.when(x["start"] >= top, this).alias("held"))
        return F.when(x["word"] == 1, after_word).otherwise(after_span), F.when((x["word"] == 1) & held.isNotNull(), F.array(held)).otherwise(none)

    def cleared(words: Column) -> Column:
        both = F.sort_array(F.concat(F.transform(words, lambda w: item(w, 1, w["value"])), F.transform(spans, lambda s: item(s, 0, F.lit("")))))
        walked = gathered(both, F.struct(F.lit(0).alias("top"), F.expr(f"cast(null as {kind})").alias("held")), step, kind)
        last = lambda r: F.when(r["state"]["held"].isNotNull(), F.array_append(r["out"], r["state"]["held"])).otherwise(r["out"])
        return F.when(F.size(spans) == 0, words).otherwise(let(walked, last))

    return let(gathered(_matches(text, WORD), F.lit(0), place, kind)["out"], cleared)


def _marked(words: Column, actions: Column) -> Column:
    """Spans of the words that are terms of ``actions`` (term, action), by start; value holds the action.  Both are walked together in the order of terms."""
    rank = KINDS.index("term")
    term = lambda a: F.struct(a["term"].alias("term"), F.lit(0).alias("word"), F.lit(0).alias("start"), F.lit(0).alias("end"), a["action"].alias("action"))
    word = lambda w: F.struct(F.lower(w["value"]).alias("term"), F.lit(1).alias("word"), w["start"].alias("start"), w["end"].alias("end"), F.lit("").alias("action"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        span = F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit("term").alias("kind"), state["action"].alias("value"))
        hit = (x["word"] == 1) & (x["term"] == state["term"])
        now = F.struct(x["term"].alias("term"), x["action"].alias("action"))
        return F.when(x["word"] == 0, now).otherwise(state), F.when(hit, F.array(span)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    start = F.struct(F.lit("").alias("term"), F.lit("").alias("action"))
    return F.sort_array(gathered(F.sort_array(F.concat(F.transform(words, word), F.transform(actions, term))), start, step, SPAN)["out"])


def _small(df: DataFrame, bytes_of: Column, rules: DisclosureRules) -> DataFrame:
    """``df``, a written table, marked for broadcast if its bytes, summed, are few."""
    total = df.agg(F.sum(bytes_of + 32)).first()[0]
    return F.broadcast(df) if (total or 0) <= rules.broadcast_bytes else df


def _classes(members: DataFrame, name: str, rules: DisclosureRules) -> DataFrame:
    """(name, df, class) of what occurs in at least ``min_support`` texts, from (version, copies, name); a class is what occurs in the same texts."""
    marks = [F.bit_xor(F.xxhash64("version", F.lit(k))) for k in range(2)]
    found = members.groupBy(name).agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("texts"), *[m.alias(f"mark_{k}") for k, m in enumerate(marks)])
    return found.where(F.col("texts") >= rules.min_support).select(name, "df", F.struct("texts", "mark_0", "mark_1").alias("class"))


def disclosing_terms(docs: DataFrame, rows: DataFrame, spans: DataFrame, rules: DisclosureRules = DisclosureRules(), text: str = "text") -> DataFrame:
    """(term, share, action) of the terms that disclose an entity, over the whole corpus; materialised."""
    none = docs.sparkSession.createDataFrame([], "term string, share double, action string")
    copies = rows.groupBy("version").agg(F.count(F.lit(1)).alias("copies"), F.max("terms").alias("terms"))  # copies of a text have the same
    mentions = materialize(copies.join(spans.select("version").distinct(), "version", "left_semi"), "pii-mentions")
    entity_of = spans.select("version", _entity().alias("entity")).distinct().join(mentions.select("version", "copies"), "version")
    entity_of = materialize(entity_of, "pii-entities")
    entity_of = entity_of.join(_classes(entity_of, "entity", rules), "entity").select("version", F.col("class").alias("e"), F.col("df").alias("df_entity")).distinct()
    entity_of = materialize(entity_of, "pii-entity-classes")
    if entity_of.isEmpty():  # nothing to disclose
        return none
    texts = F.lit(float(max(rows.count(), 1)))
    information = F.log2(texts / F.col("df_entity"))
    share = lambda df_both, df_term: F.when(information > 0, F.log2(texts * df_both / (F.col(df_term) * F.col("df_entity"))) / information)
    # Of the documents that mention anything, those with a term are a part of all with it, so they bound its share from above; only pairs that pass are made.
    term_of = mentions.select("version", "copies", F.explode("terms").alias("term"))
    terms = materialize(_classes(term_of, "term", rules), "pii-terms")
    term_of = term_of.join(terms, "term").select("version", "copies", F.col("class").alias("t"), F.col("df").alias("df_near")).distinct()
    pairs = entity_of.join(term_of, "version").where(share(F.least("df_near", "df_entity"), "df_near") >= rules.generalise_at - 1e-9)
    together = pairs.groupBy("e", "t", "df_entity", "df_near").agg(F.sum("copies").alias("df_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= rules.min_support)
    together = together.where(share(F.col("df_both"), "df_near") >= rules.generalise_at - 1e-9).select(F.col("t").alias("class"), "df_both", "df_entity").distinct()
    together = materialize(terms.select("term", "class").join(together, "class").select("term", "df_both", "df_entity"), "pii-together")
    wanted = materialize(together.select("term").distinct(), "pii-wanted")
    counted = _words(docs, text).join(_small(wanted, F.octet_length("term"), rules), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    rated = together.join(counted, "term").groupBy("term").agg(F.max(share(F.col("df_both"), "df_term")).alias("share")).where(F.col("share") >= rules.generalise_at)
    return materialize(rated.withColumn("action", F.when(F.col("share") >= rules.remove_at, "remove").otherwise("generalise")), "pii-disclosing")


def _words(docs: DataFrame, text: str) -> DataFrame:
    """(version, term) of the different words, in lower case, of each row."""
    body = docs.select(F.xxhash64(text_or_empty(text)).alias("version"), text_or_empty(text).alias("body"))  # before the words, not for each of them
    return body.select("version", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(WORD), 0), lambda w: F.lower(w)))).alias("term"))


def term_spans(docs: DataFrame, spans: DataFrame, disclosing: DataFrame, rules: DisclosureRules = DisclosureRules(), text: str = "text") -> DataFrame:
    """(version, term_spans) of the texts with disclosing terms, at every place of the whole text; value holds the action; materialised."""
    if disclosing.isEmpty():
        return docs.sparkSession.createDataFrame([], f"version long, term_spans array<{SPAN}>")
    actions = _small(disclosing.select("term", "action"), F.octet_length("term"), rules)
    found = _words(docs, text).join(actions, "term").distinct().groupBy("version").agg(F.collect_list(F.struct("term", "action")).alias("actions"))  # one text's terms
    blocks = spans.select("version", F.struct("start", "end").alias("span")).distinct().groupBy("version").agg(F.sort_array(F.collect_list("span")).alias("blocks"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    held = materialize(found.join(blocks, "version", "left").withColumn("blocks", F.coalesce("blocks", none)), "pii-held")
    body = docs.select(F.xxhash64(text_or_empty(text)).alias("version"), text_or_empty(text).alias("body"))
    rows = body.join(_small(held, 32 * F.size("actions") + 8 * F.size("blocks"), rules), "version")
    marked = let(clear_words(F.col("body"), F.col("blocks")), lambda words: _marked(words, F.col("actions")))
    return materialize(rows.select("version", marked.alias("term_spans")).where(F.size("term_spans") > 0).dropDuplicates(["version"]), "pii-term-spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` of a text cut into chunks."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    head = F.substring(F.get(chunks, first), a % CHUNK + 1, F.lit(CHUNK))
    tail = F.substring(F.get(chunks, last), F.lit(1), (b - 1) % CHUNK + 1)
    many = F.array_join(F.concat(F.array(head), F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), F.array(tail)), "")
    return F.when(b <= a, "").when(first == last, F.substring(F.get(chunks, first), a % CHUNK + 1, b - a)).otherwise(many)


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced; a span that begins inside an earlier one is covered by it."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / SECTION).cast("int"))
    within = lambda part: F.transform(F.sequence(F.lit(0), F.lit(SECTION // CHUNK - 1)), lambda c: F.substring(part, c * CHUNK + 1, F.lit(CHUNK)))
    cut = F.flatten(F.transform(numbers, lambda c: let(F.substring(text, c * SECTION + 1, F.lit(SECTION)), within)))

    def instead(word: Column, s: Column) -> Column:
        general = F.when(word.rlike(r"\p{N}"), "<NUMBER>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", "").otherwise(general)

    def all_of(chunks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            new = F.array(_piece(chunks, at, s["start"]), let(_piece(chunks, s["start"], s["end"]), lambda w: instead(w, s)))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, new).otherwise(F.expr("cast(array() as array<string>)"))

        rest = lambda r: F.concat(F.array_join(r["out"], ""), _piece(chunks, r["state"], F.length(text)))
        return let(gathered(spans, F.lit(0), step, "string"), rest)

    return let(cut, all_of)


def all_spans(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, spans, every): base spans and all spans of each row."""
    rows, spans = scan(docs, id_col, text)
    extra = term_spans(docs, spans, disclosing_terms(docs, rows, spans, rules, text), rules, text)
    base = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "value"))).alias("spans"))  # one text's spans
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = rows.join(base, "row", "left").withColumn("spans", F.coalesce("spans", none))
    every = F.when(F.col("term_spans").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "term_spans")))
    return found.join(_small(extra, 40 * F.size("term_spans"), rules), "version", "left").select("doc_id", "version", "spans", every.alias("every"))


def sanitise(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; other columns and rows as they are (a null text stays null)."""
    columns, version, spans = docs.columns, free_name(docs, "version"), free_name(docs, "spans")
    found = all_spans(docs, rules, id_col, text).where(F.size("every") > 0).dropDuplicates(["version"]).select(F.col("version").alias(version), F.col("every").alias(spans))
    found = materialize(found, "pii-rewrites")
    held = F.aggregate(F.col(spans), F.lit(0), lambda n, s: n + 40 + F.octet_length(s["value"]))
    joined = docs.withColumn(version, F.xxhash64(text_or_empty(text))).join(_small(found, held, rules), version, "left")
    new = F.when(F.col(spans).isNull(), F.col(text)).otherwise(_rewritten(F.col(text), F.col(spans)))
    return joined.select(*[new.alias(text) if c == text else joined[c] for c in columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = all_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS[:-1]]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
