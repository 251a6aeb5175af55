"""I-Match fingerprints of documents on randomised subsets of a lexicon.

The lexicon keeps the terms in a band of document frequency: not so common that every text
has them, not so rare that one edit is all they tell. It is cut at random into cells; the
distinct terms of a text that fall into a cell are sorted and hashed together. A text with
more terms uses more, smaller cells, so a cell holds about one term of it and an edit
leaves many cells as they were. The fingerprint has the hashes of the first cells at two
neighbouring resolutions, so texts of about the same length always share one.

The band says little of some texts: those of a template that many documents share, whose
words are all too common, and those of words that hardly any other text has. Where under a
quarter of the distinct terms of a text lie in the band, its fingerprint is taken from a
second lexicon, all terms of the text; two texts of which either is such a text are compared
by all their terms.

Everything runs as SQL functions and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.ordering import with_position
from armlift.llm.tables import SPACE, documents
from armlift.session import stored

# band of the share of distinct texts that have a term; a term needs two texts at least
BAND = (0.001, 0.05)
CELLS = 32
# a text with fewer terms of the band than one in FEW has its fingerprint from all its terms
FEW = 4
# a text of d distinct terms adds d to the sum of document frequencies, so the lexicon has
# at most (mean d) / BAND[0] terms at any number of texts; it is sent to all tasks up to this,
# and so are the hashes of texts that have copies
SENT_TERMS = 2_000_000

KEYS = ["doc_key", "text_key"]


def keyed(docs: DataFrame) -> DataFrame:
    """Texts named by doc_id and a hash of the text; null texts count as empty."""
    return docs.selectExpr("doc_id", "coalesce(text, '') as text").selectExpr(
        "doc_id", "coalesce(cast(doc_id as string), '') as doc_key", "xxhash64(text) as text_key", "text"
    )


def terms(text: str) -> str:
    """Distinct words of a text as 61-bit hashes."""
    hashed = f"transform(split(lower({text}), '{SPACE}'), w -> shiftrightunsigned(xxhash64(w), 3))"
    return f"array_remove(array_distinct({hashed}), shiftrightunsigned(xxhash64(''), 3))"


def sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SENT_TERMS else rows


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """The terms whose share of distinct texts lies in the band."""
    copies = stored(texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")))
    n = copies.count()
    # each of m copies of a text counts 1 / m; the texts themselves are not shuffled for that
    each = texts.join(sent(copies.where("copies > 1")), "text_key", "left").selectExpr(
        "1D / coalesce(copies, 1) as share", f"explode({terms('text')}) as term"
    )
    counts = each.groupBy("term").agg(F.expr("round(sum(share))").alias("df"))
    lo, hi = max(2.0, band[0] * n), max(2.0, band[1] * n)
    return stored(counts.where(f"df between {lo} and {hi}").select("term"))


def cells(found: str, modulus: str) -> str:
    """Hash of the terms in each of the first cells, null where there are none."""
    inside = f"filter({found}, t -> t % {modulus} < {CELLS})"
    # 42 is the hash of no terms
    each = f"transform(sequence(0, {CELLS - 1}), k -> nullif(hash(filter(near, t -> t % {modulus} = k)), 42))"
    return f"element_at(transform(array({inside}), near -> {each}), 1)"


def with_print(rows: DataFrame, found: str, name: str) -> DataFrame:
    """Replace a sorted array of distinct terms by its fingerprint (level, low, high); null without terms."""
    kept = [c for c in rows.columns if c != found]
    sized = rows.selectExpr("*", f"cast(floor(log2(greatest(size({found}), 1))) as int) as _level").selectExpr(
        "*", "shiftleft(2L, _level) as _low", "shiftleft(4L, _level) as _high"
    )
    parts = f"named_struct('level', _level, 'low', {cells(found, '_low')}, 'high', {cells(found, '_high')})"
    return sized.selectExpr(*kept, f"if(size({found}) > 0, {parts}, null) as {name}")


def text_of_print(found: str, text: str) -> str:
    """Fingerprint as a string, marked if it is of all terms; a text without words is named by its whole self."""
    listed = "array_join(transform({}, h -> coalesce(lpad(lower(hex(h & 4294967295L)), 8, '0'), '-')), ' ')".format
    shown = lambda p: f"concat_ws(':', {p}.level, {listed(f'{p}.low')}, {listed(f'{p}.high')})"
    return (
        f"case when {found}_few then concat('all:', {shown(f'{found}_all')})"
        f" when {found} is null then concat('text:', {text}) else {shown(found)} end"
    )


def likeness(a: str, b: str) -> str:
    """Share of equal cells among those that either fingerprint fills, at the resolutions both have."""
    zipped = "zip_with({}, {}, (x, y) -> named_struct('x', x, 'y', y))".format
    pairs = (
        f"case when {a}.level = {b}.level then {zipped(f'concat({a}.low, {a}.high)', f'concat({b}.low, {b}.high)')}"
        f" when {a}.level + 1 = {b}.level then {zipped(f'{a}.high', f'{b}.low')}"
        f" when {a}.level = {b}.level + 1 then {zipped(f'{a}.low', f'{b}.high')} end"
    )
    filled = f"filter({pairs}, p -> p.x is not null or p.y is not null)"
    share = f"element_at(transform(array({filled}), f -> try_divide(size(filter(f, p -> p.x = p.y)), size(f))), 1)"
    return f"coalesce({share}, 0D)"


def nearness(a: str, b: str) -> str:
    """Likeness by the terms of the band, or by all terms if the band has few of either text."""
    return f"if({a}_few or {b}_few, {likeness(f'{a}_all', f'{b}_all')}, {likeness(a, b)})"


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, keys, at, next_at, next_doc, next_text, wanted): the next document by doc_id, the first after the last."""
    rows = docs.selectExpr("doc_id", *KEYS, "length(text) as n").distinct()
    placed = stored(with_position(rows, ["doc_id", "text_key"]))
    n = placed.count()
    after = placed.selectExpr("doc_key as next_doc", "text_key as next_text", "_p_position as next_at")
    here = placed.selectExpr(
        "doc_id", *KEYS, "n div 4 as wanted", "_p_position as at", f"(_p_position + 1) % {max(n, 1)} as next_at"
    )
    return stored(here.join(after, "next_at"))


def edited(texts: DataFrame, following: DataFrame) -> DataFrame:
    """Texts with ``head``: what the next document gives to replace the last quarter of this one."""
    given = texts.selectExpr("doc_key as next_doc", "text_key as next_text", "text")
    heads = (
        given.join(following.select(*KEYS, "next_doc", "next_text", "wanted"), ["next_doc", "next_text"])
        .selectExpr(*KEYS, "left(text, cast(wanted as int)) as head")
        .groupBy(*KEYS)
        .agg(F.max("head").alias("head"))
    )
    return texts.join(heads, KEYS)


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points replaced by the first as many of the
    next document. Rows are ordered by doc_id (null first), then a hash of the text; rows
    that repeat both stand for one document and get the same result each. Null texts count
    as empty. A text without words has a fingerprint of its own, which is like equal texts only.
    """
    rows = keyed(docs)
    # every use reads the same columns, so the texts are dealt once
    texts = rows.select(*KEYS, "text")
    words = sent(lexicon(texts, band).selectExpr("term", "4L as in_band"))
    following = neighbours(rows)
    whole = edited(texts, following)

    # the word at the seam belongs to the replaced part; the words before it are in both texts
    cut = whole.selectExpr(*KEYS, "head", "text", "length(text) - length(text) div 4 as kept").selectExpr(
        *KEYS, "head", "left(text, kept) as front", "right(text, length(text) - kept) as tail"
    )
    seam = cut.selectExpr("*", r"length(regexp_extract(reverse(front), '^[^\\x20\\x09-\\x0D]*', 0)) as seam")
    parts = seam.selectExpr(
        *KEYS, "tail", "head", "left(front, length(front) - seam) as front", "right(front, seam) as seam"
    )
    part = lambda text, bits: f"named_struct('bits', {bits}L, 'terms', {terms(text)})"
    listed = parts.selectExpr(
        *KEYS, f"inline(array({part('front', 3)}, {part('concat(seam, tail)', 1)}, {part('concat(seam, head)', 2)}))"
    ).selectExpr(*KEYS, "bits", "explode(terms) as term")
    codes = (
        listed.join(words, "term", "left")
        .groupBy(*KEYS)
        .agg(F.expr("collect_set(shiftleft(term, 3) | coalesce(in_band, 0L) | bits) as codes"))
    )
    chosen = lambda bits: (
        f"array_sort(array_distinct(transform(filter(codes, c -> c & {bits}L = {bits}L), c -> shiftrightunsigned(c, 3))))"
    )
    few = lambda name: f"size({name}_terms) * {FEW} < size({name}_all_terms)"
    split_terms = codes.selectExpr(
        *KEYS, f"{chosen(5)} as own_terms", f"{chosen(1)} as own_all_terms", f"{chosen(6)} as edited_terms",
        f"{chosen(2)} as edited_all_terms",
    ).selectExpr("*", f"{few('own')} as own_few", f"{few('edited')} as edited_few")
    # all terms of the edited text are compared with those of its own text only
    prints = split_terms.withColumn(
        "edited_all_terms", F.expr("if(own_few or edited_few, edited_all_terms, slice(edited_all_terms, 1, 0))")
    )
    for name in ("own", "own_all", "edited", "edited_all"):
        prints = with_print(prints, f"{name}_terms", name)

    base = whole.selectExpr(
        *KEYS, "text", "concat(left(text, length(text) - length(text) div 4), head) as edited_text"
    ).selectExpr(
        *KEYS, "length(text) as n_chars", "md5(text) as own_text", "md5(edited_text) as edited_md5",
        "sha2(edited_text, 256) as edited_sha256",
    )
    facts = stored(base.join(prints, KEYS, "left").join(following.select("doc_id", *KEYS, "at", "next_at"), KEYS))
    after = facts.selectExpr(
        "at as next_at", "own as next", "own_all as next_all", "own_few as next_few", "text_key as next_text"
    ).dropDuplicates(["next_at"])
    return facts.join(after, "next_at").selectExpr(
        "doc_id",
        "cast(n_chars as bigint) as n_chars",
        "edited_sha256",
        f"{text_of_print('own', 'own_text')} as fingerprint",
        f"{text_of_print('edited', 'edited_md5')} as edited_fingerprint",
        f"if(own_text = edited_md5, 1D, {nearness('own', 'edited')}) as near_edited",
        f"if(text_key = next_text, 1D, {nearness('own', 'next')}) as near_next",
    )


def op9_fingerprint_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, against their edited texts and the next document's."""
    return fingerprints(documents(spark, folder))
