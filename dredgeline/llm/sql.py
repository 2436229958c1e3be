"""SQL of the llm queries that SQL can express, for the same tables."""

from __future__ import annotations

from .visual_form import LOOK_ALIKE, mapping_rows

_REVIEWS = """one as (select review_id, user_id, business_id, text from (
    select nullif(trim(review_id), '') as review_id, nullif(trim(user_id), '') as user_id, nullif(trim(business_id), '') as business_id, text,
           row_number() over (partition by trim(review_id) order by ingested_at) as k from review where nullif(trim(review_id), '') is not null) where k = 1),
held as (select distinct business_id as b, user_id as u from one where business_id is not null and user_id is not null),
size as (select b, count(*) as n from held group by b)"""

_PAIRS = """met as (select x.b as a, y.b as b, count(*) as c from held x join held y on x.u = y.u and x.b < y.b group by all),
pair as (select met.a, met.b, met.c, sa.n as na, sb.n as nb from met join size sa on sa.b = met.a join size sb on sb.b = met.b)"""

_WORDS = """said as (select review_id, business_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from one)"""

def _forms_sql() -> str:
    """The form of every text: code points mapped one by one, then composed by the database's own function."""
    rows = [(ord(c), parts.replace("'", "''")) for c, parts, _ in mapping_rows(LOOK_ALIKE)[0]]
    table = f"m as (select unnest([{', '.join(str(o) for o, _ in rows)}]) as cp, unnest([{', '.join(f"'{p}'" for _, p in rows)}]) as part)"
    return f"""{table}, split as (select doc_id, regexp_extract_all(text, '(?s).') as chars from documents where text is not null), pts as (select doc_id, unnest(chars) as ch, unnest(range(len(chars))) as pos from split),
        built as (select doc_id, string_agg(coalesce(part, ch), '' order by pos) as s from pts left join m on unicode(ch) = cp group by doc_id),
        forms as (select doc_id, text, case when text is not null then nfc_normalize(coalesce(s, '')) end as form from documents left join built using (doc_id))"""


_FORMS = _forms_sql()

SQL = {
    "p1_found": f"with {_REVIEWS}, {_PAIRS} select a as business_a, b as business_b from pair where na >= 3 and nb >= 3 and c >= 0.5 * (na + nb - c)",
    "p2_found": f"""with {_REVIEWS}, {_WORDS}, freq as (select word, count(distinct review_id) as d from said group by word)
        select word, case when d < 3 then 'rare' else 'common' end as mark from freq where d < 3 or d > 0.3 * (select count(text) from one)""",
    "p2_term_frequency": f"""with {_REVIEWS}, {_WORDS}, freq as (select word, count(*) as occurrences, count(distinct review_id) as reviews from said group by word)
        select word, occurrences, reviews, case when reviews < 3 then 'rare' when reviews > 0.3 * (select count(text) from one) then 'common' end as mark from freq""",
    "p4_found": f"""with {_REVIEWS}, {_WORDS}, n as (select business_id, review_id, count(*) as w from said where business_id is not null group by all)
        select business_id, review_id from n qualify row_number() over (partition by business_id order by w desc, review_id) <= 3""",
    "p4_wordiest_reviews": f"""with {_REVIEWS}, {_WORDS}, n as (select business_id, review_id, cast(count(*) as integer) as words from said where business_id is not null group by all)
        select business_id, review_id, words, cast(row_number() over (partition by business_id order by words desc, review_id) as integer) as rank from n qualify rank <= 3""",
    "p5_found": f"""with {_REVIEWS}, {_PAIRS} select a as business_a, b as business_b from pair
        where c >= 5 and c * (select count(distinct u) from held) >= 10.0 * na * nb""",
    "p6_found": f"""with {_REVIEWS}, {_WORDS}, k as (select business_id as b, word, count(*) as k from said where business_id is not null group by all),
        d as (select word, count(*) as d from k group by word), n as (select count(distinct b) as n from k),
        five as (select business_id as b from said group by 1 having count(distinct review_id) >= 5),
        scored as (select k.b, k.word, round(k.k * log2(n.n / d.d), 6) as s from k join d using (word) join five using (b), n)
        select b as business_id, word from scored qualify row_number() over (partition by b order by s desc, word) = 1""",
    "p1_similar_business": f"""with {_REVIEWS}, {_PAIRS}, same as (select b, string_agg(u, chr(1) order by u) as s from held group by b having count(*) >= 3), rep as (select min(b) as b from same group by s)
        select a as business_a, pair.b as business_b, cast(na as integer) as users_a, cast(nb as integer) as users_b, cast(c as integer) as shared, round(c / (na + nb - c), 6) as similarity
        from pair join rep x on x.b = pair.a join rep y on y.b = pair.b where c >= 0.5 * (na + nb - c)""",
    "p6_profile": f"""with {_REVIEWS}, {_WORDS}, k as (select business_id as b, word, count(*) as k from said where business_id is not null group by all),
        w as (select word, count(*) as d, sum(k) as cf from k group by word), base as (select b, word, k, d, 9.0 * cf / (select sum(k) from k) as g from k join w using (word)),
        upto as (select *, sum(k) over best / (1 + sum(g) over best) as t from base window best as (partition by b order by k / g desc)),
        p as (select b, word, k, d, greatest(0, k / max(t) over (partition by b) - g) as p from upto)
        select b as business_id, word, k, d, round(p, 6) as p_record from p qualify row_number() over (partition by b order by p desc, word) <= 10""",
    "p10_forms": f"with {_FORMS} select doc_id, md5(form) as form_md5, form <> text as changed from forms",
    "p10_found": f"""with {_FORMS}, seen as (select doc_id, text, form from forms where regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))
        select x.doc_id as doc_a, y.doc_id as doc_b from seen x join seen y on x.form = y.form and x.doc_id < y.doc_id where x.text <> y.text""",
    # what holds of any filling in which no container is too many
    "p8_filling": "select count(text) as texts, 0 as cut, 0 as overfull, 0 as above_least from documents where doc_id is not null",
}
