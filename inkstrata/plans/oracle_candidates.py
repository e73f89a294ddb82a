"""The SQL of the queries over candidates, their sources and reviews, and over profiles."""

from __future__ import annotations

#: Fixed values, as in the statements of the operators.
PROPOSAL_NEGATIVE = "墓葬死丧喪刑杀殺哀殇殤讽諷贬貶讥譏恨泪淚病疫苦怨鬼尸血灾災祸禍败敗辱贱賤恶惡凶"
RELATION = "case grade when 'A' then 'exact-phrase' when 'B' then 'clause-related' when 'C' then 'passage-related' else 'cultural-recomposition' end"
STYLE = "case when rarity >= 4.1 then 'austere' when feminine >= 4.2 then 'graceful' when usability >= 4.1 then 'bright' else 'classical' end"
LISTS = """,
sd as (select "left" as name, choice = 'left' as won from ch where choice in ('left', 'right') union all select "right", choice = 'right' from ch where choice in ('left', 'right')),
lk as (select name from sd group by name having 2 * count(*) filter (won) >= count(*)),
dk as (select distinct unnest(["left", "right"]) as name from ch where choice = 'both-dislike' and profile = 'prf-00-00000')"""
UNITED = """,
cu as (select given_name as name, id, grade, feminine, rarity, usability from name_candidates where grade = 'A'),
un1 as (select name, 'curated' as origin, id, grade, feminine, rarity, usability from cu union all select name, 'corpus', id, grade, feminine, rarity, usability from best where name not in (select name from cu))"""


def _features(values: list[str], rows: str) -> str:
    return f"select id, generate_subscripts(x, 1) - 1 as k, floor(least(1.0, greatest(0.0, coalesce(unnest(x), 0))) * 1e9 + 0.5) / 1e9 as value from (select id, [{', '.join(values)}] as x from {rows})"


def statements(MINED: str, P: str, LEX: str, RAW: str, CHOICES: str, ITEMS: str, FACTORY: str, ALLUSIONS: str, HAN: str, END: str) -> dict[str, str]:
    worth = "feminine >= 4 and usability >= 3.5 and name[1] <> name[2]"
    seeds = [f"case when style = 'modern' then {a} else {b} end" for a, b in ((0.55, 0.9),)] + [f"case when style = '{s}' then 0.95 else {b} end" for s, b in (("graceful", 0.45), ("gentle", 0.4), ("bright", 0.35), ("austere", 0.35))]
    writing = "case when regexp_matches(coalesce(quote, ''), '識讀|识读|字形|繁|成本|難寫|难写') then 0.55 else 0.9 end"
    seeds += ["case when style = 'modern' then 0.9 else 0.25 end", "case when regexp_matches(coalesce(quote, ''), '讀|读|音|聲|声|多音|上聲|上声|去聲|去声|陽平|阳平') then 0.55 else 0.9 end", writing, writing]
    seeds += ["case when regexp_matches(coalesce(quote, ''), '熟悉|常見|常见|使用較多|使用较多|重名|熟語|熟语|過於熟|过于熟') then 0.3 else 0.7 end", "case when regexp_matches(coalesce(chapter_title, ''), '無直接|无直接') then 0.1 else 0.65 end", "case when grade = 'A' then 1.0 else 0.25 end", "case when grade in ('C', 'D') then 1.0 else 0.2 end"]
    own = lambda s, yes, no: f"case when style = '{s}' then {yes} else {no} end"
    reviewed = [own("modern", 0.58, 0.92), own("graceful", 0.96, "feminine / 5 * 0.68"), own("gentle", 0.95, "feminine / 5 * 0.55"), own("bright", 0.95, "usability / 5 * 0.3 + 0.35"), own("austere", 0.95, "rarity / 5 * 0.35 + 0.3"), own("modern", 0.9, 0.18), "feminine / 6", "usability / 5", "usability / 5", "rarity / 5"]
    reviewed += ["case when family_score >= 2.5 then 0.85 else 0.08 end", "case grade when 'A' then 1.0 when 'B' then 0.68 else 0.28 end", "case when grade in ('A', 'B') then 0.15 when grade = 'C' then 0.72 else 1.0 end"]
    styled = f"(select *, {STYLE} as style from name_candidates)"
    tag = lambda u: f"case ascii({u}) % 4 when 0 then 2.5 when 1 then 2.0 when 2 then 1.5 else 0 end + case {u} when '玉' then 1.0 when '影' then 1.0 when '韶' then 1.5 else 0 end"
    pointers = P + """,
nc as (select *, row_number() over (order by id) as n, lead(passage_id) over (order by id) as nxt from name_candidates),
pt0 as (select nc.id, given_name as name, grade, passage_id as p1, case when n % 3 = 0 then coalesce(nxt, passage_id) else passage_id end as p2 from nc),
pt as (select pt0.*, coalesce(strpos(a.normalized_text, pt0.name[1]), 0) - 1 as i1, coalesce(strpos(b.normalized_text, pt0.name[2]), 0) - 1 as i2 from pt0 join p a on a.id = p1 join p b on b.id = p2)"""
    sentence = f"""(select coalesce(min(k), 0) from (select k, list_sum(sizes[1:k]) as e from unnest(range(1, len(sizes) + 1)) t(k)) where e > i)"""
    number = lambda s, i: sentence.replace("sizes", s).replace("> i)", f"> {i})")
    relations = pointers + f""",
sz as (select id, book_id, work_title, list_transform(regexp_extract_all(nfc_normalize(text), '[^{END}]+[{END}]?'), lambda s: length(regexp_replace(translate(s, al.raw, al.normal), '[^{HAN}]', '', 'g'))) as sizes from p cross join al),
rl as (select pt.id, p1, i1, p2, greatest(i2, 0) as i2, a.book_id as b1, b.book_id as b2, a.work_title as w1, b.work_title as w2, a.sizes as s1, b.sizes as s2 from pt join sz a on a.id = p1 join sz b on b.id = p2 where i1 >= 0)"""
    issues = pointers + f""",
tl as (select id, book_id, work_title, normalized_text, regexp_replace(translate(nfc_normalize(text), (select raw from al), (select normal from al)), '[^{HAN}]', '', 'g') as plain from p),
pr as (select id, name, {RELATION} as relation, p1, translate(name[1], (select raw from al), (select normal from al)) as c1, case when i2 < 0 then 'gone' else p2 end as p2, translate(name[2], (select raw from al), (select normal from al)) as c2 from pt),
pj as (select pr.*, a.id as k1, b.id as k2, a.plain as t1, b.plain as t2, a.book_id as b1, b.book_id as b2, a.work_title as w1, b.work_title as w2, a.normalized_text as n1 from pr left join tl a on a.id = p1 left join tl b on b.id = p2)"""
    rules = [
        ("missing-source-1", "k1 is null"), ("missing-source-2", "k2 is null"), ("missing-character-1", "k1 is not null and not contains(t1, c1)"), ("missing-character-2", "k2 is not null and length(t2) - length(replace(t2, c2, '')) < 2"),
        ("negative-context-1", f"regexp_matches(t1, '[{PROPOSAL_NEGATIVE}]')"), ("negative-context-2", f"regexp_matches(t2, '[{PROPOSAL_NEGATIVE}]')"),
        ("false-exact-phrase", "k1 is not null and k2 is not null and relation = 'exact-phrase' and (p1 <> p2 or not coalesce(contains(n1, name), false))"), ("false-clause-relation", "k1 is not null and k2 is not null and relation = 'clause-related' and p1 <> p2"),
        ("false-passage-relation", "k1 is not null and k2 is not null and relation = 'passage-related' and (b1 is distinct from b2 or w1 is distinct from w2)"),
    ]
    reviews = "with " + CHOICES + """,
rv as (select "left" as id, case choice when 'left' then 'approve' when 'both-dislike' then 'manual-review' else 'reject' end as decision from ch where profile < 'prf-00-00003' qualify row_number() over (partition by "left" order by tm desc, seq desc) = 1),
rw as (select given_name as id, case decision when 'approve' then 'approved' when 'manual-review' then 'manual-review' else 'rejected' end as status,
  case when decision is null then 'no review' when decision = 'reject' then 'not approved' end as reason from name_candidates left join rv on rv.id = given_name)"""
    undo = """ud as (select user_id as "user", cast(event_id % 20 as varchar) as item, case event_type when 'purchase' then 'love' when 'signup' then 'like' when 'error' then 'dislike' when 'view' then 'undo' end as reaction, ts as tm, event_id as seq from events where event_type <> 'click' and user_id is not null)"""
    undo_items = ITEMS.replace("event_id % 500", "event_id % 20")
    lists = """with e as (select user_id as "user", struct_pack(i := cast(event_id % 9 as varchar), l := case event_type when 'purchase' then 'f' when 'signup' then 'f' when 'error' then 'r' else 'c' end) as e, ts, event_id from events where user_id is not null),
f as (select "user", list_reduce(list(struct_pack(i := e.i, l := e.l, f := []::varchar[], r := []::varchar[], c := []::varchar[], x := []::varchar[]) order by ts, event_id),
  lambda a, s: struct_pack(i := s.i, l := s.l,
    f := case when s.l <> 'f' then case when s.l = 'r' then list_filter(a.f, lambda v: v <> s.i) else a.f end when list_contains(a.f, s.i) then list_filter(a.f, lambda v: v <> s.i) else list_append(a.f, s.i) end,
    r := case when s.l = 'f' then list_filter(a.r, lambda v: v <> s.i) when s.l = 'c' then a.r when list_contains(a.r, s.i) then list_filter(a.r, lambda v: v <> s.i) else list_append(a.r, s.i) end,
    c := case when s.l = 'r' then list_filter(a.c, lambda v: v <> s.i) when s.l = 'f' then a.c when list_contains(a.c, s.i) then list_filter(a.c, lambda v: v <> s.i) when len(a.c) >= 4 then a.c else list_append(a.c, s.i) end,
    x := case when list_contains(case s.l when 'f' then a.f when 'r' then a.r else a.c end, s.i) then list_filter(a.x, lambda v: not starts_with(v, s.i || '='))
      else list_append(list_filter(a.x, lambda v: not starts_with(v, s.i || '=')), s.i || case s.l when 'f' then '=1' when 'r' then '=-1' else '=0.25' end) end),
  struct_pack(i := '', l := '', f := []::varchar[], r := []::varchar[], c := []::varchar[], x := []::varchar[])) as s from e group by "user")
select "user", coalesce(array_to_string(s.f, ','), '') as favourites, coalesce(array_to_string(s.r, ','), '') as rejected, coalesce(array_to_string(s.c, ','), '') as compared, coalesce(array_to_string(list_sort(s.x), ','), '') as explicit from f"""
    shortlist = "with " + CHOICES + """,
sd as (select profile, choice, tm, seq * 2 as n, "left" as item, 0 as side from ch union all select profile, choice, tm, seq * 2 + 1, "right", 1 from ch),
tp as (select given_name as item, row_number() over (order by feminine desc, id) - 1 as n from name_candidates where feminine is not null qualify n < 6),
al as (select profile, item, 0 as l, tm, n from sd where choice = 'skip' union all select profile, item, 1, tm, n from sd where (choice = 'left' and side = 0) or (choice = 'right' and side = 1)
  union all select profile, item, 2, cast(null as timestamp), n from (select distinct profile from ch) cross join tp),
fi as (select * from al qualify row_number() over (partition by profile, item order by l, tm, n) = 1)
select profile, item, row_number() over (partition by profile order by l, tm, n, item) as place from fi qualify place <= 10"""
    fit, weight = "least(1.0, greatest(0.0, coalesce(feminine, 0) / 4))", "least(0.1, greatest(0.0, coalesce(rarity, 0) / 40))"
    return {
        "discovery_union": f"with {MINED}{UNITED} select * from un1",
        "discovery_views": f"""with {MINED}{UNITED}, {CHOICES}{LISTS}
select 'a-only' as mode, name from un1 where grade = 'A' and {worth} and name not in (select name from dk) union all select 'curated', name from un1 where origin = 'curated' and name not in (select name from dk)
union all select 'favorites', name from un1 where name in (select name from lk) union all select 'evidence', name from un1 where grade in ('A', 'B') and {worth} and name not in (select name from dk)""",
        "curated_views": f"""with {CHOICES}{LISTS},
r as (select given_name as name, grade = 'A' as passed from name_candidates where contains(given_name, '。') or contains(concat_ws('·', book_title, work_title), '。') or contains(quote, '。'))
select 'passed' as view, name from r where passed and name not in (select name from dk) union all select 'favourites', name from r where name in (select name from lk)
union all select 'excluded', name from r where not passed or name in (select name from dk)""",
        "allusion_browse": f"""select x.id, x.name, concat_ws('·', book_title, work_title) as source from ({ALLUSIONS}) x join name_candidates n on n.id = x.id
where x.grade = 'B' and n.category = '子' and (contains(concat_ws('·', book_title, work_title), '，') or contains(quote, '，'))""",
        "auto_style": f"select id, {STYLE} as style, {RELATION} as relation from name_candidates",
        "risk_kinds": f"""with {P} select id, case when regexp_matches(text, '墓|葬|原典|語境|语境|諷|讽|貶|贬') then 'source-context' when regexp_matches(text, '音|讀|读|聲|声') then 'pronunciation'
  when regexp_matches(text, '人物|角色|同名|碰撞') then 'name-collision' when regexp_matches(text, '錄入|录入|識讀|识读|字形') then 'usability' else 'source-context' end as kind from p""",
        "features_seed": _features(seeds, styled),
        "features_reviewed": _features(reviewed, styled),
        "adjusted_fit": f"""with a as (select id, category = '字书' as blocked, grade = 'A' as born, {fit} as f, {weight} as w, case when usability is not null then least(100, greatest(0, usability * 22)) / 100 end as s from name_candidates),
b as (select id, case when blocked or not born then 0.0 else w end as weight, case when blocked then null when not born or s is null then f else floor((f * (1 - w) + s * w) * 1000 + 0.5) / 1000 end as adjusted,
  case when blocked then 'blocked' when not born then 'not yet born' when s is null then 'no score' else 'recorded' end as status from a)
select *, row_number() over (order by coalesce(adjusted, -1) desc, id) as place from b""",
        "rerank": """with b as (select id, usability, case when grade = 'A' then floor((coalesce(feminine, 0) * 5 + coalesce(family_score, 0) * 3 + coalesce(rarity, 0) * 3 + coalesce(usability, 0) * 2) * 10 + 0.5) / 10 else 0 end as base from name_candidates),
s as (select id, case when base = 0 then 0 else floor((base * 0.9 + coalesce(usability * 20, 0) * 0.1) * 10 + 0.5) / 10 end as score from b)
select id, score, case when score <> 0 then (select count(*) from s t where t.score > s.score) + 1 end as rank from s""",
        "family_proxy": f"with {RAW} select name, least(5.0, floor(({tag('u1')} + {tag('u2')}) * 10 + 0.5) / 10) as worth from rp",
        "pointer_relations": f"""with {relations} select id, p1, i1, p2, i2, case when p1 = p2 and i2 = i1 + 1 then 'exact-phrase' when p1 = p2 and {number('s1', 'i1')} = {number('s2', 'i2')} then 'clause-related'
  when p1 = p2 or (b1 = b2 and w1 <> '' and w1 = w2) then 'passage-related' else 'cultural-recomposition' end as relation,
  'source-0001:pointer-' || substr(sha256('source-0001' || chr(10) || p1 || chr(10) || i1 || chr(10) || p2 || chr(10) || i2), 1, 16) as proposal from rl""",
        "proposal_issues": f"with {issues} " + " union all ".join(f"select id, '{code}' as code from pj where {rule}" for code, rule in rules),
        "review_join": reviews + " select * from rw",
        "review_counts": reviews + """ select count(*) as "all", count(*) filter (status = 'approved') as approved, count(*) filter (status = 'manual-review') as manual_review, count(*) filter (status = 'rejected') as rejected from rw""",
        "in_several": f"""with {MINED}, ra as (select x.unit || y.unit as name from lx x, lx y where x.unit <> y.unit),
al2 as (select distinct name, 'mined' as a from best union all select given_name, 'curated' from name_candidates union all select distinct name, 'raw' from ra)
select name, string_agg(a, ',' order by a) as artifacts from al2 group by name having count(*) > 1""",
        "merge_by_score": f"""with {MINED}, r as (select name, id, feminine as score, id as citation from best union all select given_name, id, feminine, passage_id from name_candidates where feminine is not null),
c as (select name, string_agg(distinct citation, ',' order by citation) as citations from r group by name)
select name, id, score, citations from (select * from r qualify row_number() over (partition by name order by score desc, id) = 1) join c using (name)""",
        "calibration_batches": f"""with {FACTORY}, o as (select id, max(struct_pack(s := score, b := book_id)) as r from (select * from fp where book_id is not null) group by id),
bk as (select id as b, row_number() over (order by priority, id) as k from corpus_books where status = 'ready' qualify k <= 11),
f as (select o.id, row_number() over (order by coalesce(k, 99), r.s desc nulls last, o.id) as n from o left join bk on bk.b = r.b)
select id, cast((n - 1) // 8 as int) as batch, true as calibrating from f where n <= 24
union all select id, cast((row_number() over (order by id) - 1) // 8 + 3 as int), false from f where n > 24""",
        "core_catalogue": "select id, title, category, source.originUrl as origin from corpus_books where status <> 'planned'",
        "dashboard": f"""with {RAW} select 'total' as measure, 'units' as key, count(*) as value from lx union all select 'total', 'pairs', count(*) from rp union all select 'total', 'curated', count(*) from name_candidates
union all select 'total', 'passed', count(*) from name_candidates where grade = 'A' union all select 'grade', grade, count(*) from name_candidates group by grade union all select 'category', category, count(*) from name_candidates group by category""",
        "profile_shortlist": shortlist,
        "pairwise_dislikes": f"""with {CHOICES} select distinct profile, unnest(["left", "right"]) as item, cast(-0.75 as double) as signal from ch where choice = 'both-dislike'""",
        "undo_fold": f'with {undo_items} select "user", generate_subscripts(weights, 1) - 1 as k, floor(unnest(weights) * 1e6 + 0.5) / 1e6 as weight, events from wt',
        "undo_order": f"""with {undo}, l as (select "user", item, max(struct_pack(a := tm, b := seq)) filter (reaction = 'undo') as u from ud group by all)
select "user", item, min(struct_pack(a := tm, b := seq)).b as seq from ud join l using ("user", item) where reaction <> 'undo' and (u is null or struct_pack(a := tm, b := seq) > u) group by all""",
        "undo_exposure": f"""with {undo}, s as (select "user", item, case when reaction <> 'undo' then 1 when lag(reaction) over w <> 'undo' then -1 else 0 end as n from ud window w as (partition by "user", item order by tm, seq)
  union all select user_id, cast(event_id % 20 as varchar), 1 from events where event_type = 'click' and user_id is not null)
select "user", item, sum(n)::bigint as shown from s group by all having sum(n) > 0""",
        "list_states": lists,
        "sound_keys": r"select doc_id, regexp_replace(lower(trim(title)), '[\s-]+', '', 'g') as key from documents where title is not null",
        "json_recovery": """select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as value from events""",
        "size_gate": f"with {P} select id as name, strlen(text) as bytes from p where strlen(text) > 1024",
    }
