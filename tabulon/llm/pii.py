"""Personal data and what gives it away, in DataFrame functions only.

Base spans are mail addresses, IP addresses, card and phone numbers. Information-theoretic sanitisation adds terms: the corpus
tells in how many texts a term stands together with an entity, in how many either occurs, and so how many of the entity's
bits the term reveals, PMI(term; entity) / IC(entity). Terms above a first threshold are generalised wherever they stand in
documents that hold the entity, above a second one removed. Counts cover all distinct texts, so copies of one prove nothing;
what few texts say is smoothed towards independence, not left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load, lookup, shielded, stored

#: Shares of an entity's information that a term may reveal before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Pseudo-texts with a term in which an entity is as frequent as everywhere.
LEAN = 5.0
#: Terms that stand near an entity are broadcast to the count of all words up to so many (some 60 bytes each).
BROADCAST_TERMS = 500_000

#: The patterns, possessive and anchored at the start of a run where that changes no match, so that scans stay
#: linear and no recursion grows with a text. \\G admits what begins where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": rf"v.value rlike r'^{_OCTET}(?:\\.{_OCTET}){{3}}$'".replace("\\\\", "\\"),
    "card": "length(replace(replace(v.value, ' ', ''), '-', '')) between 16 and 19 and luhn_check(replace(replace(v.value, ' ', ''), '-', ''))",
    "phone": "length(regexp_replace(v.value, '[^0-9]', '')) between 8 and 15",
}
ENTITY = {"email": "lower(value)", "ip": "value", "card": "regexp_replace(value, '[^0-9]', '')", "phone": "regexp_replace(value, '[^0-9]', '')"}
#: What a valid match of a kind needs, told faster than by its pattern.
HINTS = {"email": "instr({0}, '@') > 0", "ip": "{0} rlike '[0-9][.][0-9]'", "card": "{0} rlike r'[0-9](?:[ -]?[0-9]){{15}}'", "phone": "instr({0}, '+') > 0"}
#: What a term is generalised to, by the first test that it passes.
CLASSES = [("^[0-9]+$", "[NUMBER]"), ("[0-9]", "[CODE]"), (r"^\p{Lu}", "[NAME]"), ("", "[WORD]")]
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
WORD = r"[\p{L}\p{M}\p{N}]++"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _positions(text: str, pattern: str, hint: str | None = None) -> str:
    """SQL: all matches of a pattern in an expression as (start, end, value), in code points.

    Matches and the gaps between them give the lengths; starts are their sums, in blocks of 64, so that a text with very
    many matches doesn't cost their square.
    """
    summed = "aggregate({}, 0, (a, y) -> a + y)".format
    block = f"transform(sequence(0, (size(l) - 1) div 64), b -> {summed('slice(l, b * 64 + 1, 64)')})"
    starts = f"transform(array({block}), s -> transform(sequence(0, size(s) - 1), b -> {summed('slice(s, 1, b)')}))[0]"
    before = f"o[(i - 1) div 64] + {summed('slice(l, ((i - 1) div 64) * 64 + 1, (i - 1) % 64)')} + char_length(x.g[i - 1])"
    each = f"transform(transform(sequence(1, size(l)), i -> named_struct('at', {before}, 'v', x.m[i - 1])), p -> named_struct('start', p.at, 'end', p.at + char_length(p.v), 'value', p.v))"
    lengths = "transform(sequence(1, size(x.m)), i -> char_length(x.g[i - 1]) + char_length(x.m[i - 1]))"
    inner = f"transform(array({lengths}), l -> transform(array({starts}), o -> {each})[0])[0]"
    whole = f"transform(array(named_struct('g', split({text}, r'{pattern}', -1), 'm', regexp_extract_all({text}, r'{pattern}', 0))), x -> {inner})[0]"
    where = f"{hint.format(text)} and {text} rlike r'{pattern}'" if hint else f"{text} rlike r'{pattern}'"
    return f"case when {where} then {whole} else cast(array() as {_SPAN}) end"


def base_spans(text: str, kind: str) -> Column:
    """Valid matches of a kind in a text column (not null): array of (start, end, value), by start, end exclusive."""
    return F.expr(f"filter({_positions(text, PATTERNS[kind], HINTS[kind])}, v -> {VALID[kind]})")


_ENTITIES = "array_distinct(concat(" + ", ".join(f"transform({k}, v -> concat('{k}:', {ENTITY[k].replace('value', 'v.value')}))" for k in PATTERNS) + "))"
_BASE = "concat(" + ", ".join(f"transform({k}, v -> named_struct('start', v.start, 'end', v.end))" for k in PATTERNS) + ")"


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, email, ip, card, phone, t, words, times) per distinct text; h: xxhash64 of it; t: the text if it holds an entity; words: distinct terms; times: rows."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("times"))
    rows = rows.select("h", "t", "times", *(base_spans("t", k).alias(k) for k in PATTERNS))
    held = F.expr("case when size(email) + size(ip) + size(card) + size(phone) > 0 then t end").alias("t")
    return rows.select("h", *PATTERNS, held, F.expr(f"array_distinct(transform(regexp_extract_all(t, r'{WORD}', 0), w -> lower(w)))").alias("words"), "times")


def disclosing(texts: DataFrame, lean: float = LEAN, generalise: float = GENERALISE) -> DataFrame:
    """(h, term, share): terms that reveal at least ``generalise`` of the information of an entity in the text; ``texts``: distinct.

    Entities of one text all give its terms the same share, so one of them stands for all.
    """
    n_texts = texts.count()
    n = F.lit(float(max(1, n_texts)))
    has = stored(texts.where("t is not null").select("h", F.explode(F.expr(_ENTITIES)).alias("entity")), "held")
    n_entity = has.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).withColumn("times", F.col("n_entity"))
    has = lookup(has, n_entity, ["entity"], n_texts, "times", F.col("h"))
    has = stored(has.groupBy("h", F.when(F.col("n_entity") > 1, F.col("entity")).alias("entity")).agg(F.first("n_entity").alias("n_entity")), "holders")
    words = stored(texts.where("t is not null").select("h", F.explode("words").alias("term")), "words")
    asked = stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("times")), "asked")
    terms = asked.select("term")
    terms = F.broadcast(terms) if asked.count() <= BROADCAST_TERMS else terms
    n_term = texts.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_term = stored(n_term.join(asked, "term"), "counted")  # times: texts with an entity that have the term
    n_words = words.count()

    def share(n_both: Column) -> Column:
        # log2(P(entity | term) / P(entity)) of P(entity) bits, with lean pseudo-texts at P(entity)
        rate = F.col("n_entity") / n
        ic = -F.log2(rate)
        return F.when(ic > 0, F.log2((n_both + lean * rate) / (F.col("n_term") + lean) / rate) / ic).otherwise(0.0).alias("share")

    single = lookup(has.where("entity is null").select("h", "n_entity").join(words, "h"), n_term, ["term"], n_words, "times", F.col("h")).select("h", "term", share(F.lit(1)))
    several = has.where("entity is not null").join(words, "h")
    pairs = several.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"))
    pairs = pairs.join(n_term.drop("times"), "term").select("entity", "term", "n_both", share(F.col("n_both"))).where(F.col("share") >= generalise)
    of_pairs = lookup(several.select("h", "entity", "term"), pairs, ["entity", "term"], n_words, "n_both", F.col("h"))
    of_pairs = of_pairs.where("share is not null").select("h", "term", "share")
    return single.where(F.col("share") >= generalise).union(of_pairs).groupBy("h", "term").agg(F.max("share").alias("share"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lean: float = LEAN, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(id_col, h, email, ip, card, phone, terms) per row of ``docs``; h: xxhash64 of the text; terms: (start, end, value), with what stands for the term.

    Null counts as empty text. Rows that repeat an id and a text have the same spans; rows are never merged. An empty table
    gives no rows. Only documents that hold an entity can have terms: clean ones stay as they are. Terms inside a base span
    go with it and aren't listed.
    """
    texts = stored(distinct_texts(docs, text_col), "texts")
    reveals = stored(disclosing(texts, lean, generalise), "disclosing")
    held = texts.where("t is not null")
    at = held.select("h", F.expr(f"inline({_positions('t', WORD)})")).select("h", F.lower("value").alias("term"), F.col("value").alias("word"), "start", "end")
    label = F.when(F.col("share") >= remove, "")
    for pattern, name in CLASSES:
        label = label.when(F.col("word").rlike(pattern), name)
    by_text = at.join(reveals, ["h", "term"]).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", "end", label.alias("value")))).alias("terms"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    out = lookup(rows, held.select("h", *PATTERNS, "times").join(by_text, "h", "left"), ["h"], docs.count(), "times", F.col("id"))
    none = F.expr(f"cast(array() as {_SPAN})")
    outside = F.expr(f"filter(terms, w -> not exists({_BASE}, b -> b.start < w.end and w.start < b.end))")
    return out.select(F.col("id").alias(id_col), "h", *(F.coalesce(k, none).alias(k) for k in PATTERNS), F.coalesce(outside, none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with base spans replaced by their kind, revealing terms by their class or nothing; all columns and rows stay.

    A term is generalised to the class of what it looks like: a number, a code of letters and digits, a name, a word.

    Overlapping spans are replaced once, from the first one's start to the last one's end, by the first one's label.
    """
    inner, name = shielded(docs)
    id_col, text_col = name[id_col], name[text_col]
    found = spans(inner, id_col, text_col, **how)
    marks = ", ".join([*(f"transform({k}, v -> named_struct('start', v.start, 'end', v.end, 'label', '{label}'))" for k, label in LABELS.items()), "transform(terms, v -> named_struct('start', v.start, 'end', v.end, 'label', v.value))"])
    edits = found.select(F.col(id_col).alias("pii_id"), F.col("h").alias("pii_h"), F.expr(f"array_sort(concat({marks}))").alias("pii_marks")).where(F.size("pii_marks") > 0).distinct()
    edits = stored(edits, "edits")
    rows = inner.withColumn("pii_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = rows.join(edits.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("pii_id")) & (F.col("pii_key") == F.col("pii_h")), "left")
    t = f"`{text_col}`"
    step = f"case when m.start >= a.pos then named_struct('pos', m.end, 'out', concat(a.out, array(substring({t}, a.pos + 1, m.start - a.pos), m.label))) else named_struct('pos', greatest(a.pos, m.end), 'out', a.out) end"
    begin = "named_struct('pos', 0, 'out', cast(array() as array<string>))"
    new = f"aggregate(pii_marks, {begin}, (a, m) -> {step}, a -> concat(array_join(a.out, ''), substring({t}, a.pos + 1)))"
    return out.withColumn(text_col, F.expr(f"case when pii_marks is null then {t} else {new} end")).select(*inner.columns).toDF(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, in every document."""
    found = spans(load(spark, sf_dir, "documents"))
    listed = ", ".join(f"transform({k}, v -> concat('{k}:', v.start, ':', v.end))" for k in PATTERNS)
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.sha2(F.expr(f"array_join(concat({listed}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({listed}, transform(terms, v -> concat('term:', v.start, ':', v.end))), ',')").alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )
