"""SQL for DuckDB that gives the rows of a registered query."""

from cardwatch.llm.licenses import EQUIVALENT, KNOWN, TITLES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),"
    r" '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
)

_SAID = "'<|im_end|><|im_start|>assistant ok'"


def _canonical(line: str) -> str:
    plain = f"' ' || regexp_replace(lower({line}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for other, one in EQUIVALENT.items():
        plain = f"replace({plain}, ' {other} ', ' {one} ')"
    notice = r"^[^\p{L}\p{N}©]*(copyright|\(c\)|©)[\s:,©(]*(c\)|©)?\s*[0-9]"
    marked = r"^[^\p{L}\p{N}©]*(copyright[\s:,]*(\(c\)|©)|©)"
    rights = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
    return (
        f"case when regexp_matches(lower({line}), '{marked}')"
        f" or regexp_matches(lower({line}), '{notice}')"
        f" or regexp_matches(lower({line}), '{rights}') then '' else trim({plain}) end"
    )


def _lines(text: str) -> str:
    split = f"string_split(coalesce({text}, ''), chr(10))"
    return f"list_filter(list_transform({split}, lambda x: {_canonical('x')}), lambda x: x <> '')"


def _whole(lines: str) -> str:
    titles = ", ".join(f"'{t}'" for t in TITLES)
    return f"array_to_string(list_filter({lines}, lambda x: x not in ({titles})), ' ')"


_LICENSES = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in KNOWN.items() for text in texts
)

#: The usual CRC of 32 bits, reflected: by bytes, from a table made by its rule.
_CRC_TABLE = """
    select list(list_reduce(range(8), lambda c, i:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as tab
    from (select unnest(range(256)) as n)
"""

SQL = {
    "op1_chat": f"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', {_SAID} union all select -1, 1, 'assistant', {_SAID}
),
parts as (
    select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as escaped,
        regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'),
            '<(\\\\*)\\|', '<\\\\\\1|', 'g') as escaped_role
    from said
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
        as loss_sha256,
    cast(sum(length(escaped) + length(escaped_role) + 24) as bigint) as formatted_chars
from parts group by conv_id
""",
    "op8_license_scan": f"""
with known as (
    select sha256({_whole("lines")}) as sha, min(license_id) as license
    from (select license_id, {_lines("text")} as lines
          from (values {_LICENSES}) as t(license_id, text))
    where len(lines) > 0 group by 1
),
canonical as (select doc_id, {_lines("text")} as lines from documents),
digests as (
    select doc_id, lines, sha256(coalesce({_whole("lines")}, '')) as digest from canonical
),
single as (
    select doc_id, string_agg(distinct license, ',' order by license) as notices
    from (select doc_id, sha256(unnest(lines)) as sha from digests) join known using (sha)
    group by doc_id
)
select doc_id, digest, license as license_id, coalesce(notices, '') as notices
from digests left join known on digest = sha left join single using (doc_id)
""",
    "op2_decontamination": f"""
with item_words as (select item_id, {_WORDS} as w from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) as size,
        list_slice(w, i, i + least(len(w), 10) - 1) as words
    from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
          from item_words where len(w) > 0)
),
doc_words as (select doc_id, {_WORDS} as w from documents),
places as (
    select doc_id, size, p, list_slice(w, p, p + size - 1) as words
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p
          from doc_words, (select distinct size from windows))
),
hits as (select doc_id, item_id, p, size from places join windows using (size, words)),
hit_words as (
    select doc_id, count(distinct q) as n
    from (select doc_id, unnest(range(p, p + size)) as q from hits) group by doc_id
),
hit_items as (
    select doc_id, count(*) as n, string_agg(name, ',' order by name) as names
    from (select distinct doc_id, cast(item_id as varchar) as name from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit,
    coalesce(i.n, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(h.n, 0) > 0 as contaminated
from doc_words left join hit_words h using (doc_id) left join hit_items i using (doc_id)
""",
    "op11_importance": f"""
with crc_table as ({_CRC_TABLE}),
doc_words as (select doc_id, unnest(w) as word from (select doc_id, {_WORDS} as w from documents)),
aim_words as (select unnest({_WORDS}) as word from benchmark),
buckets as (
    select word, xor(list_reduce(list_transform(range(octet_length(encode(word))),
            lambda i: cast('0x' || substr(hex(encode(word)), 2 * i + 1, 2) as bigint)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
    from (select word from doc_words union select word from aim_words), crc_table
),
s as (select bucket, count(*) as n from doc_words join buckets using (word) group by 1),
t as (select bucket, count(*) as n from aim_words join buckets using (word) group by 1),
sums as (select (select coalesce(sum(n), 0) from s) as all_s, (select coalesce(sum(n), 0) from t) as all_t),
gains as (
    select s.bucket, cast(floor(1000 * ln(
        (coalesce(t.n, 0) + 1.0::double) * (all_s + 10000.0::double)
        / ((s.n + 1.0::double) * (all_t + 10000.0::double)))) as bigint) as gain
    from s left join t using (bucket), sums
),
found as (
    select doc_id, count(*) as n, sum(gain) as total
    from doc_words join buckets using (word) join gains using (bucket) group by 1
),
weighed as (
    select doc_id, coalesce(n, 0) as n_features,
        cast(coalesce((total - ((total % n) + n) % n) // n, 0) as bigint) as weight,
        cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h
    from documents left join found using (doc_id)
),
scored as (
    select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint)
        as score
    from weighed
),
placed as (
    select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
        count(*) filter (n_features >= 20) over () * 10 // 100 as drawn
    from scored
)
select doc_id, n_features, weight, score,
    case when n_features >= 20 and place <= drawn then place end as rank
from placed
""",
    "op12_hard_negatives": """
with whole as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
    select a.vec_id as anchor, c.vec_id as other, a.label = c.label as mate,
        cast(list_dot_product(cast(a.v as double[]), cast(c.v as double[])) as bigint) as score
    from whole a join whole c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
),
positives as (
    select anchor, other as positive, score as positive_score from scores where mate
    qualify row_number() over (partition by anchor order by score desc, other) <= 5
)
select p.anchor as anchor_id, positive as positive_id,
    cast(row_number() over w as integer) as rank, other as negative_id, positive_score,
    score as negative_score
from positives p join scores s on p.anchor = s.anchor and not mate
    and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.anchor, positive order by score desc, other)
qualify row_number() over w <= 5
""",
}
