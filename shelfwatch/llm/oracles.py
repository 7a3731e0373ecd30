"""SQL for the native operators, in the dialect of the engine that checks them. All values are written out."""

from __future__ import annotations

_LARGEST = """case when {0} < 256 then {0}
        else (({0} - ({0} // 128 - 1) * 128 + 1) << ({0} // 128 - 1)::int) - 1 end"""

QUALITY = r"""
with texts as (
    select row_number() over () as row_no, doc_id, lang, source, coalesce(text, '') as text from documents
), listed as (
    select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from texts
), windows as (
    select row_no, place, array_to_string(words[place:place + 7], ' ') as words
    from (select row_no, words, unnest(range(1, len(words) - 6)) as place from listed)
), covered as (
    select row_no, count(distinct place + j) as n
    from (select row_no, place from windows qualify count(*) over (partition by row_no, words) > 1), range(8) t(j)
    group by 1
), measured as (
    select l.row_no, doc_id, lang, source, len(words) as n_words,
        length(array_to_string(words, '')) as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(c.n, 0) as n_repeat_words
    from listed l left join covered c using (row_no)
), based as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured
), entries as (
    select row_no, lang, source, unnest([
        {'rule': 'symbols', 'value': n_symbols * 1000 // greatest(word_chars, 1)},
        {'rule': 'dup_lines', 'value': n_dup_lines * 1000 // greatest(n_lines, 1)},
        {'rule': 'repeats', 'value': n_repeat_words * 1000 // greatest(n_words, 1)},
        {'rule': 'word_length', 'value': word_chars * 10 // greatest(n_words, 1)}], recursive := true)
    from based where not base_failed
), cells as (
    select *, case when value < 256 then value
        else (length(bin(value)) - 8) * 128 + (value >> (length(bin(value)) - 8)) end as cell
    from entries
), levels as (
    select 0 as level, lang, source, rule, cell, count(*) as docs from cells group by all
    union all select 1, lang, null, rule, cell, count(*) from cells group by all
    union all select 3, null, null, rule, cell, count(*) from cells group by all
), ranked as (
    select *, sum(docs) over (partition by level, lang, source, rule) as total,
        sum(docs) over (partition by level, lang, source, rule order by cell) as upto,
        case when rule in ('symbols', 'word_length') then 950 else 995 end as share
    from levels
), found as (
    select level, lang, source, rule, max(total) as n,
        min(cell) filter (1000 * upto >= (1000 - share) * total) as low,
        min(cell) filter (1000 * upto >= 500 * total) as mid,
        min(cell) filter (1000 * upto >= share * total) as high
    from ranked group by level, lang, source, rule
), quantiles as (
    select level, lang, source, rule, n, LARGEST(low) as low, LARGEST(mid) as mid, LARGEST(high) as high from found
), smooth as (
    select o.lang, o.source, o.rule,
        DRAWN(low) as low, DRAWN(mid) as mid, DRAWN(high) as high
    from quantiles o
    join quantiles l on l.level = 1 and o.lang is not distinct from l.lang and o.rule = l.rule
    join quantiles a on a.level = 3 and o.rule = a.rule
    where o.level = 0
), limits as (
    select lang, source, rule,
        mid - greatest(case rule when 'word_length' then 3 * (mid - low) else 0 end, 10) as low,
        mid + greatest(case rule when 'symbols' then 2 when 'word_length' then 3 else 1 end * (high - mid),
            case rule when 'symbols' then 20 when 'dup_lines' then 100 when 'repeats' then 80 else 10 end) as high
    from smooth
), outside as (
    select distinct e.row_no from entries e
    join limits l on e.lang is not distinct from l.lang and e.source is not distinct from l.source and e.rule = l.rule
    where e.value > l.high or (e.rule = 'word_length' and e.value < l.low)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and row_no not in (select row_no from outside) as kept
from based"""
for _part in ("low", "mid", "high"):
    QUALITY = QUALITY.replace(f"LARGEST({_part})", _LARGEST.format(_part))
    QUALITY = QUALITY.replace(
        f"DRAWN({_part})",
        f"((o.n * o.{_part} + 200 * ((l.n * l.{_part} + 200 * a.{_part}) // (l.n + 200))) // (o.n + 200))",
    )

MIXING = """
with recursive masses as (
    select source, sum(length(coalesce(text, '')) + 1) as mass from documents group by source
), weights as (
    select *, floor(1000 * pow(mass::double, 0.5))::bigint as weight from masses
), rated as (
    select source, (sum(mass) over ())::double * weight / ((sum(weight) over ())::double * mass) as rate from weights
), parted as (
    select source, greatest(ceil(rate / 64), 1)::int as parts, rate / greatest(ceil(rate / 64), 1) as mean from rated
), steps as (
    select source, mean, 0 as k, exp(-mean) as p, exp(-mean) as total from parted
    union all
    select source, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) from steps
    where k < ceil(mean + 12 * sqrt(mean) + 20)
), keyed as (
    select row_number() over () as row_no, d.*, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key from documents d
), draws as (
    select row_no, key, k.source, unnest(range(1, parts + 1)) as part
    from keyed k join parted r on k.source is not distinct from r.source
), uniform as (
    select row_no, source, (('0x' || substr(md5('mix-1|count|' || part || '|' || key), 1, 12))::bigint + 0.5::double)
        / 281474976710656::double as u
    from draws
), counted as (
    select row_no, count(*) as n_copies from uniform u join steps s on u.source is not distinct from s.source and s.total < u.u
    group by row_no
), copied as (
    select k.*, n_copies, unnest(range(1, n_copies + 1)) as copy from keyed k join counted using (row_no)
)
select * exclude (row_no, key), ('0x' || substr(md5('mix-1|order|' || key || '|' || copy), 1, 12))::bigint as shuffle_key
from copied"""
