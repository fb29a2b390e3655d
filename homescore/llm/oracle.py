"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Every node with the least node that it reaches, from `nodes(id)` and `links(a, b)`.
_REACH = """
    ends_of as (select a, b from links union select b, a from links),
    reach as (select id, id as r from nodes union select ends_of.b, reach.r from reach join ends_of on ends_of.a = reach.id),
    nearest as (select id, min(r) as r from reach group by id)"""

ORACLE: dict[str, str] = {
    "op1_relative_lz_dedup": f"""
        with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
        places as (select doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) as i from d),
        windows as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as t from places),
        again as (select t from windows group by t having count(*) > 1),
        starts as (select doc_id, i from windows join again using (t)),
        gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from starts),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        left_over as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
                      from words anti join gone using (doc_id, p) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed,
               sha256(coalesce(kept, '')) as kept_sha256
        from d left join left_over using (doc_id)""",
    "op2_lsh_forest_near_dedup": f"""
        with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
        places as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as i from d),
        shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from places),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y using (g)
                   where x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
        links as (select a, b from shared s join sizes p on p.doc_id = a join sizes q on q.doc_id = b
                  where 100 * s.n >= 85 * (p.n + q.n - s.n)),
        nodes as (select doc_id as id from documents),{_REACH}
        select doc_id, coalesce(n, 0) as n_shingles, r as component_id, doc_id = r as kept
        from documents join nearest on id = doc_id left join sizes using (doc_id)""",
    "op9_hnsw_near_vectors": f"""
        with recursive v as (select vec_id, embedding::double[] as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id < q.vec_id and len(p.e) = len(q.e)
                  where list_cosine_similarity(p.e, q.e) >= 0.95),
        nodes as (select vec_id as id from embeddings),{_REACH},
        counts as (select a, count(*) as n from ends_of group by a)
        select vec_id, coalesce(n, 0) as n_links, r as component_id, vec_id = r as kept
        from embeddings join nearest on id = vec_id left join counts on a = vec_id""",
    "op11_ngram_decontamination": f"""
        with d as (select row_number() over () as r, doc_id, {_TERMS.format(_LOWER)} as w from documents),
        b as (select item_id::varchar as item, {_TERMS.format(_LOWER)} as w, least(len(w), 10) as k from benchmark),
        item_places as (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from b where k > 0),
        item_windows as (select distinct k, array_to_string(w[i:i + k - 1], ' ') as t, item from item_places),
        places as (select r, w, k, unnest(range(1, len(w) - k + 2)) as i
                   from d, (select distinct k from item_windows) where len(w) >= k),
        found as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as t from places),
        hits as (select r, i, k, item from found join item_windows using (k, t)),
        covered as (select r, count(*) as n from (select distinct r, unnest(range(i, i + k)) as p from hits) group by r),
        items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
        from d left join covered using (r) left join items using (r)""",
    "op12_euler_tour_prefix_trie": r"""
        with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as i
                   from conversations where conv_id is not null),
        steps as (select distinct c, flatten(list_transform(range(1, len(c::varchar) + 1),
                      lambda k: [ascii(substr(c::varchar, k, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as s from t),
        convs as (select c, c - c % 20 as base, xor(4294967295::bigint, list_reduce([4294967295::bigint] || s,
                      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end)) % 4 as h from steps),
        turns as (select v.c, t.i, role, text from convs v join t on t.c = v.base and t.i <= v.h
                  union all select v.c, t.i, role, text from convs v join t on t.c = v.c and t.i > v.h),
        placed as (select c, row_number() over (partition by c order by i) as d, text,
                          concat(length(role), ':', role, length(text), ':', text) as e from turns),
        keyed as (select c, d, text, md5(string_agg(e, '') over (partition by c order by d)) as k from placed
                  union all select c, 0, '', '' from convs),
        members as (select c, d, text, d = max(d) over (partition by c) as at_end, min(c) over (partition by d, k) as node from keyed),
        nodes as (select node, d, count(*) as n_convs, len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) as words,
                         coalesce(string_agg(c::varchar, ',' order by c) filter (at_end), '') as ends from members group by node, d),
        linked as (select n.*, p.node as parent from nodes n left join members p on p.c = n.node and p.d = n.d - 1),
        counted as (select l.*, (select count(*) from linked q where q.parent = l.node and q.d = l.d + 1) as n_children from linked l),
        below as (select m.node, m.d, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.words)::bigint as saved
                  from counted u join members m on m.c = u.node and m.d <= u.d group by m.node, m.d)
        select node as conv_id, d as depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved as saved_tokens, sha256(ends) as ends_sha256
        from counted join below using (node, d)""",
    "op13_zone_map_hard_negatives": """
        with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q,
                          case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
                   from embeddings where embedding is not null and label is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select a.r, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
                          list_inner_product(a.q, b.q)::bigint as score
                   from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
        places as (select *, row_number() over (partition by r order by score desc, other_id) as place from scored where same),
        positives as (select r, anchor_id, place, other_id as positive_id, score as positive_score from places where place <= 5),
        ranked as (select p.*, n.other_id as negative_id, n.score as negative_score,
                          row_number() over (partition by p.r, p.place order by n.score desc, n.other_id) as rank
                   from positives p join scored n on n.r = p.r and not n.same
                   where 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score)
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
        from ranked where rank <= 10""",
}
