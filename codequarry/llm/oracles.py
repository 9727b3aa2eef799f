"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

SUBSTRINGS = r"""
with texts as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), windows as (
    select doc_id, s, array_to_string(words[s:s + 19], ' ') as body
    from (select doc_id, words, unnest(range(1, len(words) - 18)) as s from texts)
), repeated as (
    select doc_id, s from windows qualify row_number() over (partition by body order by doc_id, s) > 1
), gone as (
    select distinct doc_id, unnest(range(s, s + 20)) as p from repeated
), kept as (
    select doc_id, string_agg(word, ' ' order by p) as body, count(*) as n
    from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from texts) as words
    anti join gone using (doc_id, p)
    group by doc_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(body, '')) as kept_sha256
from texts left join kept using (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with items as (
    select item_id::varchar as item, {_WORDS} as words from benchmark
), item_windows as (
    select distinct item, least(len(words), 10) as size, array_to_string(words[s:s + 9], ' ') as body
    from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as s from items where len(words) > 0)
), texts as (
    select doc_id, {_WORDS} as words from documents
), windows as (
    select doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') as body
    from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as s
          from texts, (select distinct size from item_windows))
), found as (
    select doc_id, s, size, item from windows join item_windows using (size, body)
), hit as (
    select doc_id, count(*) as n from (select distinct doc_id, unnest(range(s, s + size)) as p from found) group by doc_id
), of_items as (
    select doc_id, count(*) as n, string_agg(item, ',' order by item) as list
    from (select distinct doc_id, item from found) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(of_items.n, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, hit.n is not null as contaminated
from texts left join hit using (doc_id) left join of_items using (doc_id)
"""

HARD_NEGATIVES = """
with vectors as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as parts
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.parts, b.parts)::bigint as score
    from vectors as a join vectors as b on a.vec_id <> b.vec_id
    where a.vec_id % 50 = 0
), positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), ranked as (
    select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
           row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank
    from positives join scores using (anchor_id)
    where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select * from ranked where rank <= 3
"""

# Pattern, and the group whose length counts with its least length, of every kind in its order.
_ASSIGN = (
    r'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])'
    r'["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)'
)
_SECRETS = (
    ("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 0), ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40), ("slack", "xox[abpr]-[0-9A-Za-z-]+", 0, 25),
)


def _kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches are put between two control characters, at which the text is split."""
    return rf"""
    select doc_id, {order} as kind_no, '{kind}' as kind, start, start + len(match) as stop
    from (
        select doc_id, split_part(piece, chr(3), 1) as match, k,
               (coalesce(sum(len(piece) - (k > 1)::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0))::bigint as start
        from (
            select doc_id, unnest(pieces) as piece, unnest(range(1, len(pieces) + 1)) as k
            from (select doc_id, string_split(regexp_replace(body, '{pattern}', chr(2) || '\0' || chr(3), 'g'), chr(2)) as pieces from texts)
        )
    )
    where k > 1 and len(regexp_extract(match, '{pattern}', {group})) >= {least}"""


SECRETS = rf"""
with texts as (
    select doc_id, translate(coalesce(text, ''), chr(2) || chr(3), chr(1) || chr(1)) as body from documents
), spans as ({" union all ".join(_kind(k, *kind) for k, kind in enumerate(_SECRETS))}
), lists as (
    select doc_id, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access, count(*) filter (kind_no = 2) as n_hex,
           string_agg(concat(kind, ':', start, ':', stop), ',' order by start, kind_no) filter (kind_no < 3) as base,
           string_agg(concat(kind, ':', start, ':', stop), ',' order by start, kind_no) as spans
    from spans group by doc_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join lists using (doc_id)
"""
