"""SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

from armlift.llm.mixing import MAX_PASSES, WEIGHTS
from armlift.llm.sharding import MULTIPLIERS, OFFSETS, PRIME

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def words(text: str) -> str:
    return WORDS.replace("{text}", f"coalesce({text}, '')")


def mixing(table: str = "documents", seed: int = 1) -> str:
    """Common table expressions ending in ``mixed`` (doc_id, size, source_size, target, copies)."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
    sizes as (
      select doc_id, source, cast(len({words('text')}) as bigint) as size,
        md5(concat_ws(':', doc_id, '{seed}')) as shuffle
      from {table}
    ),
    totals as (select source, cast(sum(size) as bigint) as source_size from sizes group by source),
    ranked as (select *, row_number() over (order by source nulls last) - 1 as source_rank from totals),
    weighted as (select *, [{weights}][source_rank % {len(WEIGHTS)} + 1] as weight from ranked),
    capacity as (
      select *, row_number() over (order by {MAX_PASSES} * source_size / weight, source_rank) as place from weighted
    ),
    levels as (
      select a.*, (
        (select sum(source_size) from capacity)
        - {MAX_PASSES} * coalesce((select sum(source_size) from capacity b where b.place < a.place), 0)
      ) / cast((select sum(weight) from capacity b where b.place >= a.place) as double) as level
      from capacity a
    ),
    water as (
      select place, level from levels where level * weight <= {MAX_PASSES} * source_size order by place limit 1
    ),
    targets as (
      select source, source_rank, source_size,
        case when place < (select place from water) then cast({MAX_PASSES} * source_size as double)
          else (select level from water) * weight end as target
      from levels
    ),
    queued as (
      select doc_id, size, source_rank, source_size, target,
        row_number() over (partition by source_rank order by shuffle, doc_id, size) as position,
        sum(size) over (partition by source_rank order by shuffle, doc_id, size rows unbounded preceding) as upto
      from sizes join targets on sizes.source is not distinct from targets.source
    ),
    copies as (
      select q.*, pass, case when target = 0 then null else (pass * source_size + upto) / target end as finish
      from queued q, range({MAX_PASSES}) passes(pass)
    ),
    line as (
      select *, case when size > 0 and finish is not null then size else 0 end as asks from copies
    ),
    running as (
      select *, sum(asks) over (
        order by finish is null, finish, source_rank, position, pass rows unbounded preceding) as total
      from line
    ),
    mixed as (
      select source_rank, position, any_value(doc_id) as doc_id, any_value(size) as size,
        any_value(source_size) as source_size, any_value(target) as target,
        count(*) filter (asks > 0 and total <= (select sum(size) from sizes)) as copies
      from running group by source_rank, position
    )"""


ORACLES: dict[str, str] = {
    "op7_mix_documents": f"with {mixing()} "
    "select doc_id, size, source_size, target, cast(size * copies as bigint) as taken from mixed",
}


def checksums() -> str:
    """Common table expressions ending in ``summed`` (doc_id, size, text_crc32)."""
    step = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"""
    codes as (
      select list(list_reduce(range(8)::bigint[], lambda a, k: {step}, i::bigint) order by i) as t from range(256) r(i)
    ),
    spelled as (select doc_id, text, hex(encode(coalesce(text, ''))) as h from documents),
    summed as (
      select doc_id, cast(len(h) // 2 + 1 as bigint) as size,
        case when text is not null then xor(4294967295, list_reduce(
          list_transform(range(1, len(h), 2), lambda j: ('0x' || h[j:j+1])::bigint),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) end as text_crc32
      from spelled, codes
    )"""


def shuffled(source: str, seed: int = 1) -> str:
    """One pass of the Feistel network over column x of ``source`` (id, x, n, a, b), as nested queries."""
    inner = f"select id, n, a, b, x // b as l, x % b as r from {source}"
    for i, (factor, offset) in enumerate(zip(MULTIPLIERS, OFFSETS)):
        other, own, side = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        last = len(MULTIPLIERS) - 1 - i
        inner = f"select *, (({other} + {seed}) % {PRIME} * {factor} + {offset}) % {PRIME} as f from ({inner})"
        inner = f"select *, (f * f + {OFFSETS[last]}) % {PRIME} * {MULTIPLIERS[last]} % {PRIME} as g from ({inner})"
        inner = f"select id, n, a, b, {other}, ({own} + g) % {side} as {own} from ({inner})"
    return f"select id, l * b + r as x, n, a, b from ({inner})"


ORACLES["op1_shard_documents"] = f"""
    with recursive {checksums()},
    numbered as (select *, row_number() over (order by doc_id nulls first, size, text_crc32 nulls first) - 1 as id from summed),
    bounds as (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as b from summed),
    first as (select id, id as x, n, (n + b - 1) // b as a, b from numbered, bounds),
    walk as ({shuffled('first')} union all {shuffled('(select * from walk where x >= n)')}),
    placed as (select id, x from walk where x < n)
    select doc_id, size, text_crc32, 'rows' as law, cast(x % 8 as int) as shard, x // 8 as slot, cast(null as int) as grown_shard
    from numbered join placed using (id)"""


ORACLES["op4_group_near_duplicates"] = f"""
    with recursive listed as (
      select doc_id, {words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
    ),
    sets as (
      select doc_id, list_distinct(case when len(w) > 1
        then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from listed
    ),
    items as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
    shared as (
      select a.doc_id as a, b.doc_id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as both_have
      from items a join items b using (shingle) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
    ),
    links as (select a, b from shared where 100 * both_have >= 80 * (n_a + n_b - both_have)),
    reached as (
      select doc_id, doc_id as other from documents
      union select doc_id, b from reached join links on other = a
    )
    select doc_id, cast(any_value(len(s)) as bigint) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
    from reached join sets using (doc_id) group by doc_id"""


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_rank_documents"] = f"""
    with spelled as (select doc_id, {TERMS} as terms from documents where text is not null),
    docs as (select row_number() over () as d, doc_id, terms, len(terms) as n from spelled where len(terms) > 0),
    totals as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from docs),
    wanted as (select item_id, term, count(*) as times from (select item_id, unnest({TERMS}) as term from benchmark) group by item_id, term),
    counted as (select d, term, count(*) as tf from (select d, unnest(terms) as term from docs) group by d, term),
    held as (select term, count(*) as df from counted group by term),
    weighted as (
      select term, cast(floor(1000 * ln((2 * n_docs + 2) / cast(2 * df + 1 as double))) as bigint) as w from held, totals
    ),
    scored as (
      select item_id, doc_id, d, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))) as bigint) as score
      from wanted join counted using (term) join weighted using (term) join docs using (d), totals
      group by item_id, doc_id, d
    )
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
    from scored where score > 0 qualify rank <= 20"""


ORACLES["op12_link_near_vectors"] = """
    with recursive rows_of as (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
    valid as materialized (
      select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from rows_of
      where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(v, lambda x: x <> 0)) > 0
    ),
    links as (
      select a.r as a, b.r as b from valid a join valid b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
      where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
    ),
    reached as (select r, r as other from rows_of union select reached.r, b from reached join links on other = a)
    select any_value(x.vec_id) as vec_id, (select count(*) from links where a = reached.r) as n_links,
      min(y.vec_id) as component_id, any_value(x.vec_id) = min(y.vec_id) as kept
    from reached join rows_of x on x.r = reached.r join rows_of y on y.r = other group by reached.r"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text, with the table of steps in ``codes``."""
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    code = f"list_transform(range(1, len(hex(encode({text}))), 2), lambda j: ('0x' || hex(encode({text}))[j:j+1])::bigint)"
    return f"xor(4294967295, list_reduce({code}, lambda a, b: {step}, 4294967295))"


STEP = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"

ORACLES["op13_group_spellings"] = f"""
    with recursive codes as (
      select list(list_reduce(range(8)::bigint[], lambda a, k: {STEP}, i::bigint) order by i) as t from range(256) r(i)
    ),
    runs as (
      select doc_id, run, count(*) as times from (
        select row_number() over () as r, doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
        from documents
      ) where length(run) >= 7 group by doc_id, run
    ),
    hashed as (select run, times, {crc32("concat(doc_id, ':', run)")} as h from runs, codes),
    changed as (
      select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed
    ),
    words as (select word, cast(sum(times) as bigint) as n from changed where length(word) >= 7 group by word having sum(times) >= 2),
    shorter as (
      select word, n, place, left(word, place - 1) || substr(word, place + 1) as less
      from (select word, n, unnest(range(1, length(word) + 1)) as place from words)
    ),
    near as (
      select distinct a.word as word, b.word as other, b.n as other_n from shorter a join shorter b using (less, place) where a.word <> b.word
      union select word, less, w.n from shorter join (select word as less, n from words) w using (less)
      union select w.word, s.word, s.n from shorter s join words w on s.less = w.word
    ),
    ranked as (
      select word, other, other_n, count(*) over (partition by word) as n_near,
        row_number() over (partition by word order by other_n desc, other) as place
      from near
    ),
    forms as (
      select w.word, w.n, coalesce(n_near, 0) as n_near,
        case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n
      from words w left join (select * from ranked where place = 1) r using (word)
    ),
    walked as (
      select word, word as root, 0 as steps from forms
      union all select walked.word, form, steps + 1 from walked join forms on forms.word = root where form is not null
    )
    select word, n, n_near, form, form_n, root from forms join (
      select word, arg_max(root, steps) as root from walked group by word
    ) using (word)"""
