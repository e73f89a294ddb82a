"""The queries of the catalog as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from . import oracle_candidates

#: Fixed values, as in the statements of the operators: characters, lists and domains.
FUNCTION_CHARACTERS = "在之兮者也矣于於以而与與为為乃则則曰何所且将將公君我你"
HARD_NEGATIVE = "死丧喪墓葬尸鬼刑杀殺戮辱贱賤凶灾災祸禍病疫殇殤"
WINDOW_NEGATIVE = "死丧喪墓葬尸鬼刑杀殺戮辱贱賤凶灾災祸禍病疫殇殤踯躅愁悲哀怨恨泣泪淚苦忧憂患"
WARFARE = "兵战戰伐攻败敗虏虜斩斬围圍"
SCREEN_FUNCTION = "不无無未莫其之兮者也矣于於以而与與為为乃则則曰何所且将將公君我你今昔日中上下来去入出有又正曾"
SCREEN_NEGATIVE = "墓葬死喪丧兵刑殺杀哀殤殇諷讽貶贬譏讥愁恨淚泪病苦怨孤寡鬼尸血災灾禍祸敗败辱賤贱惡恶凶"
CATEGORIES = ("经", "史", "子", "集", "字书")
STATUSES = ("planned", "source-reviewed", "ready")

HAN = r"\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
END = "。！？!?；;"

P = """p as (select distinct id, book_id, work_id, chapter_id, work_title, chapter_title, ord, text, normalized_text, source_url, verification_url from corpus_passages),
al as (select string_agg(raw, '' order by raw) as raw, string_agg(normalized, '' order by raw) as normal from char_aliases where length(raw) = 1 and length(normalized) = 1),
pp as (select p.*, translate(text, (select raw from al), (select normal from al)) as plain from p)"""

RANKED = P + f""",
o as (select id, book_id, work_id, dense_rank() over (order by book_id) - 1 as book_ord, row_number() over (order by book_id, ord, id) - 1 as passage_ord from p),
w as (select book_id, work_id, row_number() over (order by min(passage_ord)) - 1 as work_ord from o group by all),
r as (select o.id, book_ord, work_ord, passage_ord,
  least(length(coalesce(normalized_text, '')) + case when regexp_matches(text, '[{END}]') then 0 else 200 end + least(length(regexp_replace(text, '[^()（）]', '', 'g')), 10) * 100, 65535) as rank
  from o join w using (book_id, work_id) join p using (id))"""

POSTINGS = RANKED + """,
ch as (select id, unnest(range(1, length(normalized_text) + 1)) as i, normalized_text from p where normalized_text <> ''),
post as (select id, normalized_text[i] as unit, list(i - 1 order by i) as positions from ch group by all)"""

QUERY = """
nq as (select distinct q from (select array_to_string(case when x[1] = '岑' then x[2:3] else x[1:2] end, '') as q
  from (select regexp_extract_all(full_name, '[\\x{3400}-\\x{9FFF}]') as x from name_candidates)) where q <> ''),
qs as (select q as query, substr(t, 1, 1) as u1, case when length(t) > 1 then substr(t, 2, 1) end as u2 from (select q, translate(q, (select raw from al), (select normal from al)) as t from nq))"""

# Brute force: every pair of postings, then the first by the order in which evidence is looked at.
SEARCH = POSTINGS + "," + QUERY + """,
f as (select query, u1, u2, post.id, positions, book_ord, work_ord, passage_ord, rank from qs join post on unit = u1 join r on r.id = post.id),
s as (select query, u1, u2, post.id, positions, book_ord, work_ord, passage_ord, rank from qs join post on unit = u2 join r on r.id = post.id),
near as (select a.query, a.u1, a.u2, a.id, a.rank, a.passage_ord, len(list_intersect(list_transform(a.positions, lambda x: x + 1), b.positions)) > 0 as fwd, len(list_intersect(list_transform(b.positions, lambda x: x + 1), a.positions)) > 0 as bwd
  from f a join s b on a.query = b.query and a.id = b.id where a.u1 <> a.u2 or len(a.positions) > 1),
ab as (select *, case when fwd then 'A' else 'B' end as g, case when fwd then 'adjacent' when bwd and u1 <> u2 then 'reversed' else 'apart' end as kind from near),
abn as (select *, row_number() over (partition by query, g order by rank, passage_ord) as i from ab qualify i <= 8),
abd as (select abn.*, case when g = 'A' and not coalesce(b.source.segmentation = 'punctuated' and contains(pp.plain, u1 || u2), false) then 'B' else g end as grade from abn join pp using (id) left join corpus_books b on b.id = pp.book_id),
abf as (select query, grade, row_number() over (partition by query, grade order by g, i) as place, case when grade = g then kind else 'adjacent, not direct' end as kind, id as id_a, cast(null as varchar) as id_b from abd),
cc as (select a.query, a.work_ord, a.id as id_a, b.id as id_b from f a join s b on a.query = b.query and a.work_ord = b.work_ord and a.passage_ord <> b.passage_ord
  qualify row_number() over (partition by a.query, a.work_ord order by a.rank, a.passage_ord, b.rank, b.passage_ord) = 1),
cf as (select query, 'C' as grade, row_number() over (partition by query order by cast(work_ord as varchar)) as place, 'one work' as kind, id_a, id_b from cc qualify place <= 6),
dd as (select a.query, a.book_ord, a.id as id_a, b.id as id_b from f a join s b on a.query = b.query and a.book_ord = b.book_ord and a.work_ord <> b.work_ord
  qualify row_number() over (partition by a.query, a.book_ord order by a.rank, a.passage_ord, b.rank, b.passage_ord) = 1),
df as (select query, 'D' as grade, row_number() over (partition by query order by cast(book_ord as varchar)) as place, 'one book' as kind, id_a, id_b from dd qualify place <= 6),
f1 as (select * from f qualify row_number() over (partition by query, book_ord order by rank, passage_ord) = 1),
s1 as (select * from s qualify row_number() over (partition by query, book_ord order by rank, passage_ord) = 1),
ef as (select a.query, 'E' as grade, row_number() over (partition by a.query order by cast(a.book_ord as varchar), cast(b.book_ord as varchar)) as place, 'two books' as kind, a.id as id_a, b.id as id_b
  from f1 a join s1 b on a.query = b.query and a.book_ord <> b.book_ord qualify place <= 6),
lone as (select query, id, rank, passage_ord, 1 as side from f where u1 <> u2 and not exists (select 1 from s where s.query = f.query and s.id = f.id)
  union all select query, id, rank, passage_ord, 2 from s where u1 <> u2 and not exists (select 1 from f where f.query = s.query and f.id = s.id)),
lones as (select *, row_number() over (partition by query, side order by rank, passage_ord) as i from lone qualify i <= 4),
single as (select query, id, 1 as side, row_number() over (partition by query order by rank, passage_ord) as i from f where u2 is null or (u1 = u2 and len(positions) = 1) qualify i <= 8),
ff as (select query, 'F' as grade, row_number() over (partition by query order by side, i) as place, 'single' as kind, id as id_a, cast(null as varchar) as id_b from (select query, id, side, i from lones union all select * from single)),
found as (select * from abf union all select * from cf union all select * from df union all select * from ef union all select * from ff)"""

LEX = """lex0 as (select given_name[i] as unit, i, first_category, second_category, feminine, rarity, usability, family_score from (select *, unnest(range(1, length(given_name) + 1)) as i from name_candidates)),
lx as (select unit, min(case when i = 1 then first_category else second_category end) as category, coalesce(max(feminine), 0) as feminine, coalesce(max(rarity), 0) as rarity, coalesce(max(usability), 0) as usability,
  coalesce(cast(max(family_score) >= 4.5 as int), 0) as family from lex0 group by unit)"""

MINED = P + "," + LEX + f""",
src as (select pp.*, b.title, b.category as book_category, b.priority, coalesce(b.source.segmentation = 'punctuated', false) as punctuated,
  length(coalesce(normalized_text, '')) + least(length(regexp_replace(text, '[^()（）]', '', 'g')), 10) * 80 as penalty from pp join corpus_books b on b.id = book_id where b.source is not null),
un as (select id, pos, plain[pos + 1] as unit from (select id, plain, unnest(range(0, length(plain))) as pos from src) where regexp_matches(plain[pos + 1], '[{HAN}]')),
ld as (select id, unit as u1, pos, unnest([struct_pack(d := 1, u := lead(unit, 1) over k, p := lead(pos, 1) over k), struct_pack(d := 2, u := lead(unit, 2) over k, p := lead(pos, 2) over k),
  struct_pack(d := 3, u := lead(unit, 3) over k, p := lead(pos, 3) over k), struct_pack(d := 4, u := lead(unit, 4) over k, p := lead(pos, 4) over k)]) as n from un window k as (partition by id order by pos)),
lp as (select id, u1, n.u as u2, pos, n.p as pos2, n.d as distance from ld where u1 in (select unit from lx) and n.u in (select unit from lx)),
prs as (select src.*, u1, u2, distance from lp join src using (id) where (distance = 1 and pos2 = pos + 1) or (distance > 1 and punctuated)),
mined as (select u1 || u2 as name, case when distance = 1 and punctuated then 'A' else 'B' end as grade, id, book_id, title, book_category, distance,
  case when distance = 1 and punctuated then 10000 else 0 end + (x.feminine + y.feminine) / 2 * 120 + (x.usability + y.usability) / 2 * 90 + (x.rarity + y.rarity) / 2 * 45 + (x.family + y.family) * 80 + (4 - priority) * 60 - penalty as score,
  (x.feminine + y.feminine) / 2 as feminine, (x.rarity + y.rarity) / 2 as rarity, (x.usability + y.usability) / 2 as usability, x.family + y.family as family, x.category as category1, y.category as category2
  from prs join lx x on x.unit = u1 join lx y on y.unit = u2),
best as (select * from mined qualify row_number() over (partition by name order by score desc, id, distance, grade) = 1)"""

RAW = LEX + """,
rp as (select a.unit || b.unit as name, a.unit as u1, b.unit as u2, a.category as c1, b.category as c2, floor((a.feminine + b.feminine) / 2 * 10 + 0.5) / 10 as feminine,
  floor((a.usability + b.usability) / 2 * 10 + 0.5) / 10 as usability, a.family + b.family as family from lx a join lx b on a.unit <> b.unit)"""

FACTORY = r"""fp as (select distinct id, lower(regexp_replace(book_id, '^\s+|\s+$', '', 'g')) as book_id, work_title, text, normalized_text, case when not isnan(score) then score end as score from factory_passages)"""

CLAUSES = "al as (select string_agg(raw, '' order by raw) as raw, string_agg(normalized, '' order by raw) as normal from char_aliases)," + FACTORY + f""",
cl0 as (select id, generate_subscripts(x, 1) as k, unnest(x) as c from (select id, regexp_extract_all(nfc_normalize(text), '[^，,{END}]+[，,{END}]?') as x from fp)),
cl1 as (select id, k, regexp_replace(c, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+$', '', 'g') as clause from cl0),
cl2 as (select *, regexp_replace(translate(clause, (select raw from al), (select normal from al)), '[^{HAN}]', '', 'g') as plain from cl1),
cl as (select id, row_number() over (partition by id order by k) as n, clause, plain, cast(coalesce(sum(length(plain)) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) as int) as start,
  regexp_matches(clause, '[{END}]$') as closes from cl2 where plain <> '')"""

WINDOWS = CLAUSES + "," + LEX + f""",
nx as (select *, lead(clause) over (partition by id order by n) as nc, lead(plain) over (partition by id order by n) as np from cl),
wi0 as (select id, start, start + length(plain) as "end", clause as text, plain, 0 as penalty from nx where length(plain) <= 40
  union all select id, start + o, start + least(o + 24, length(plain)), plain[o + 1 : o + 24], plain[o + 1 : o + 24], 80 from (select *, unnest(range(0, length(plain), 16)) as o from nx where length(plain) > 40) where length(plain) - o >= 8 and (o = 0 or o + 8 < length(plain))
  union all select id, start, start + length(plain) + length(np), clause || nc, plain || np, 0 from nx where not closes and np is not null),
wi as (select *, length(plain) as size, (select count(*) from unnest(range(2, length(plain) + 1)) t(i) where plain[i] = plain[i - 1]) as repeats from wi0
  where length(plain) between 4 and 40 and not regexp_matches(plain, '[{WINDOW_NEGATIVE}]') and length(regexp_replace(text, '[^{WARFARE}]', '', 'g')) <= 1 and not regexp_matches(text, '[|0-9()（）\\[\\]{{}}]')),
kn as (select * from lx where not contains('{FUNCTION_CHARACTERS}', unit)),
wid as (select *, row_number() over () as w from wi),
po as (select w, x.unit as u1, y.unit as u2, (x.feminine + y.feminine) / 2 * 28 + (x.usability + y.usability) / 2 * 24 + (x.rarity + y.rarity) / 2 * 8 + case when d = 1 then 160.0 else greatest(30.0, 95.0 - d * 18) end as s
  from (select *, unnest([1, 2, 3, 4]) as d from (select *, unnest(range(1, length(plain) + 1)) as i from wid)) q join kn x on x.unit = plain[i] join kn y on y.unit = plain[i + d] where x.unit <> y.unit and i + d <= length(plain)),
ps as (select w, list(s order by s desc) as s, count(*) as n, list_sort(list_distinct(list(u1) || list(u2))) as naming from po group by w),
win as (select id, start, "end", text, s[1] + coalesce(s[2], 0) * 0.3 + least(n, 12) * 4 - size * 0.5 - repeats * 40 - penalty as score, n as opportunities, naming from wid join ps using (w)
  qualify row_number() over (partition by id, start, "end" order by score desc, text desc) = 1)"""

NAMEABLE = WINDOWS + """,
nw as (select *, row_number() over (partition by id order by score desc, start, "end") as k from win),
nt as (select id, max(case when k = 1 then score end) as s1, max(case when k = 2 then score end) as s2, list_sort(list_distinct(flatten(list(naming)))) as naming from nw where k <= 3 group by id),
nb as (select fp.id, coalesce(s1 + coalesce(s2, 0) * 0.35 + (4 - greatest(1, least(3, coalesce(priority, 2)))) * 30, -100000) as score, coalesce(naming, []) as naming from fp left join corpus_books b on b.id = fp.book_id left join nt on nt.id = fp.id)"""

USABLE = FACTORY + f""",
us as (select * from fp where length(normalized_text) between 8 and 480 and not regexp_matches(text, '[{HARD_NEGATIVE}]') and length(regexp_replace(text, '[^{WARFARE}]', '', 'g')) <= 2
  and length(regexp_replace(text, '[^|0-9]', '', 'g')) <= greatest(3.0, length(normalized_text) * 0.04) and score > -15)"""

ITEMS = """it as (select cast(vec_id as varchar) as item, chr(cast(97 + vec_id % 26 as int)) || chr(cast(97 + floor(vec_id / 26) % 26 as int)) as name,
  list_transform(embedding[1:13], lambda x: least(1.0, greatest(0.0, cast(x as double) + 0.5))) as features, 's' || (vec_id % 40) as sound, vec_id % 5 as book, vec_id % 4 as relation, label as category, vec_id % 6 as style from embeddings),
re as (select user_id as "user", cast(event_id % 500 as varchar) as item, case event_type when 'purchase' then 'love' when 'signup' then 'like' when 'error' then 'dislike' when 'view' then 'skip' end as reaction, ts as tm, event_id as seq from events where event_type <> 'click' and user_id is not null),
sh as (select user_id as "user", cast(event_id % 500 as varchar) as item from events where event_type = 'click' and user_id is not null),
sg as (select *, case reaction when 'love' then 1.0 when 'like' then 0.45 when 'dislike' then -1.0 else 0.0 end::double as worth from re),
dl as (select sg.*, worth - coalesce(lag(worth) over (partition by "user", sg.item order by tm, seq), 0) as delta, features from sg join it using (item)),
wt as (select "user", list_reduce(list(struct_pack(w := features, d := delta) order by tm, seq),
  lambda a, s: struct_pack(w := list_transform(list_zip(a.w, s.w), lambda z: floor(least(3.0, greatest(-3.0, z[1] + 0.55 * s.d * (z[2] - 0.5))) * 1e12 + 0.5) / 1e12), d := 0.0::double),
  struct_pack(w := list_transform(range(13), lambda i: 0.0::double), d := 0.0::double)).w as weights, count(*) as events from dl group by "user"),
ex as (select "user", item, arg_max(worth, struct_pack(a := tm, b := seq)) as signal from sg group by all having signal <> 0),
pw as (select "user", coalesce(weights, list_transform(range(13), lambda i: 0.0::double)) as weights from (select distinct user_id as "user" from events where user_id is not null) left join wt using ("user")),
ft0 as (select s."user", it.item, list_sum(list_transform(list_zip(weights, features), lambda z: z[1] * (z[2] - 0.5))) + coalesce(signal, 0) * 1.25 as u from pw s cross join it left join ex on ex."user" = s."user" and ex.item = it.item),
ft as (select "user", item, case when u >= 36 then 1.0 when u <= -36 then 0.0 else 1 / (1 + exp(-u)) end as fit from ft0),
pe as (select "user", item, count(*) as shown, least(0.48, ln(1 + count(*)) * 0.1) as penalty from sh group by all),
rc as (select "user", item, row_number() over (partition by "user" order by min(struct_pack(a := tm, b := seq)) desc) as back from re group by "user", item qualify back <= 6)"""


def _similarity(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}.features[1:6], {y}.features[1:6]), lambda z: z[1] * z[2]))"
    return f"""coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)} * {dot(b, b)}), 0), 0) * 0.45 + (len(list_intersect(string_split({a}.name, ''), string_split({b}.name, ''))) > 0)::int * 0.2
  + ({a}.sound = {b}.sound)::int * 0.15 + ({a}.book = {b}.book)::int * 0.1 + ({a}.relation = {b}.relation)::int * 0.1"""


NEXT = ITEMS + f""",
stp as (select "user", count(distinct item) as step from re group by all),
fr as (select ft.*, coalesce(step, 0) as step from ft left join stp using ("user") where not exists (select 1 from re where re."user" = ft."user" and re.item = ft.item)),
mt as (select fr."user", fr.item, fr.fit, fr.step, coalesce(max({_similarity('a', 'b')}), 0) as closest, count(*) filter (a.sound = b.sound) as ss, count(*) filter (a.category = b.category) as sc, count(*) filter (a.relation = b.relation) as sr, count(*) filter (a.style = b.style) as st,
  greatest(count(*) filter (contains(b.name, a.name[1])), count(*) filter (contains(b.name, a.name[2]))) as ms
  from fr join it a on a.item = fr.item left join rc on rc."user" = fr."user" left join it b on b.item = rc.item group by all),
md as (select mt.*, ['fit', 'fit', 'diverse', 'fit', 'explore'][step % 5 + 1] as mode, coalesce(penalty, 0) as pn, 1 - closest as dv,
  case when ss = 0 and sc < 3 and ms < 2 then 0 when ss = 0 and ms < 2 then 1 when ss = 0 and ms < 3 then 2 else 3 end as level from mt left join pe on pe."user" = mt."user" and pe.item = mt.item),
so as (select *, case when mode = 'explore' then (1 - abs(fit - 0.5) * 2) * 0.5 + dv * 0.3 + fit * 0.2 - pn
  else fit * 0.75 + dv * 0.25 + case when mode = 'diverse' then (st = 0)::int * 0.18 + (sr = 0)::int * 0.12 + (sc = 0)::int * 0.08 else 0 end - pn end as sco from md)
select "user", mode, level, item, floor(sco * 1e6 + 0.5) / 1e6 as score from so qualify row_number() over (partition by "user" order by level, sco desc, item) = 1"""


CURATED = P + "," + QUERY + """,
fg as (select id, '《' || coalesce(book_title, '') || '·' || coalesce(work_title, '') || '》' as source, '《' || split_part(coalesce(book_title, '') || '·' || coalesce(work_title, ''), '·', 1) || '》' as family,
  translate(quote, (select raw from al), (select normal from al)) as quote from name_candidates where quote is not null),
h as (select query, u1, u2, fg.*, contains(quote, u1) as h1, coalesce(contains(quote, u2), false) as h2 from qs, fg where contains(quote, u1) or contains(quote, u2)),
own as (select query, case when u2 is not null and contains(quote, u1 || u2) then 'A' when u2 is not null and h1 and h2 and u1 <> u2 then 'B' else 'F' end as grade, id as id_a, cast(null as varchar) as id_b from h),
cs as (select query, 'C' as grade, min(id) filter (h1) as id_a, min(id) filter (h2) as id_b from h where u2 is not null group by query, source having not bool_or(h1 and h2)),
lf as (select * from h where u2 is not null and h1 and not h2 qualify row_number() over (partition by query, source order by id) = 1),
ls as (select * from h where u2 is not null and h2 and not h1 qualify row_number() over (partition by query, source order by id) = 1),
ds as (select a.query, 'D' as grade, a.id as id_a, b.id as id_b from lf a join ls b on a.query = b.query and a.family = b.family and a.source <> b.source qualify row_number() over (partition by a.query order by a.id, b.id) <= 12),
es as (select a.query, 'E' as grade, a.id as id_a, b.id as id_b from lf a join ls b on a.query = b.query and a.family <> b.family qualify row_number() over (partition by a.query order by a.id, b.id) <= 12)"""


def _with(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


def _blank(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '\s+', '', 'g'), '') = ''"


def _https(c: str) -> str:
    return rf"coalesce(regexp_matches({c}, '^https://\S+$'), false)"


def _issues() -> str:
    complete = f"source is not null and {_https('source.originUrl')} and not ({_blank('source.editionNote')}) and not ({_blank('source.rightsNote')}) and coalesce(regexp_matches(source.retrievedAt, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'), false)"
    rules = [
        ("INVALID_BOOK_ID", "error", "id", "corpus_books", "not regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$')"),
        ("EMPTY_BOOK_TITLE", "error", "id", "corpus_books", _blank("title")),
        ("PLANNED_BOOK_SOURCE_PENDING", "warning", "id", "corpus_books", "status = 'planned' and source is null"),
        ("READY_BOOK_MISSING_SOURCE", "error", "id", "corpus_books", f"status = 'ready' and not ({complete})"),
        ("REVIEWED_BOOK_MISSING_SOURCE", "error", "id", "corpus_books", f"status not in ('planned', 'ready') and not ({complete})"),
        ("UNKNOWN_PASSAGE_BOOK", "error", "id", "corpus_passages", "book_id is null or book_id not in (select id from corpus_books)"),
        ("EMPTY_NORMALIZED_TEXT", "error", "id", "corpus_passages", _blank("normalized_text")),
        ("PASSAGE_MISSING_SOURCE_URL", "error", "id", "corpus_passages", f"not {_https('source_url')}"),
        ("PASSAGE_MISSING_VERIFICATION_URL", "error", "id", "corpus_passages", f"not {_https('verification_url')}"),
        ("PASSAGE_SOURCE_MISMATCH", "error", "c.id", "corpus_passages c join corpus_books b on b.id = c.book_id", "b.source.originUrl is not null and c.source_url is distinct from b.source.originUrl"),
        ("READY_BOOK_WITHOUT_PASSAGES", "error", "id", "corpus_books", "status = 'ready' and id not in (select book_id from corpus_passages where book_id is not null)"),
        ("DUPLICATE_BOOK_ID", "error", "id", "(select id from corpus_books group by id having count(*) > 1)", "true"),
        ("DUPLICATE_PASSAGE_ID", "error", "id", "(select id from corpus_passages group by id having count(*) > 1)", "true"),
    ]
    return " union ".join(f"select '{code}' as code, {target} as target_id, '{severity}' as severity from {source} where {rule}" for code, severity, target, source, rule in rules)


def _report() -> str:
    parts = ["select 'total' as measure, 'passages' as key, count(*) as value from p", "select 'total', 'characters', coalesce(sum(length(normalized_text)), 0)::bigint from p", "select 'total', 'books', count(*) from corpus_books"]
    parts += [f"select 'category', '{c}', count(*) from corpus_books where category = '{c}'" for c in CATEGORIES]
    parts += [f"select 'status', '{s}', count(*) from corpus_books where status = '{s}'" for s in STATUSES]
    return _with(P, " union all ".join(parts))


def _citations() -> str:
    base = "from name_candidates n left join p on p.id = n.passage_id where "
    parts = [f"select 'CITATION_PASSAGE_MISSING' as code, n.id as target_id {base} p.text is null", f"select 'CITATION_QUOTE_NOT_IN_PASSAGE', n.id {base} p.text is not null and not coalesce(contains(p.text, n.quote), false)"]
    parts += [f"select 'CITATION_{f.upper()}_DIFFERS', n.id {base} p.text is not null and n.{f} is distinct from p.{f}" for f in ("book_id", "work_title", "chapter_title", "source_url", "verification_url")]
    parts.append("select 'CITATION_CHARACTER_NOT_IN_QUOTE', id from name_candidates where len(list_filter(string_split(given_name, ''), lambda c: not coalesce(contains(quote, c), false))) > 0")
    return _with(P, " union all ".join(parts))


_FEATURES = """with u as (select given_name as item, grade = 'A' as e, feminine / 5 as f, rarity / 5 as r, usability / 5 as s, family_score / 2 as y from name_candidates),
v as (select item, [0.9, f, 0.35 + f * 0.45, 0.25 + s * 0.45, 0.25 + r * 0.5, 0.15, 0.5, s, s, r, y, case when e then 1.0 else 0.35 end, 0.0] as x from u)
select item, generate_subscripts(x, 1) - 1 as k, floor(least(1.0, greatest(0.0, coalesce(unnest(x), 0))) * 1e9 + 0.5) / 1e9 as value from v"""

_CULTURE = """with s as (select id, given_name, case when grade in ('A', 'B') then floor((coalesce(feminine, 0) * 5 + coalesce(family_score, 0) * 3 + coalesce(rarity, 0) * 3 + coalesce(usability, 0) * 2) * 10 + 0.5) / 10 else 0 end as score from name_candidates)
select id, given_name, score, case when score <> 0 then (select count(*) from s b where b.score > s.score) + 1 end as rank from s"""

_POOL = USABLE.replace("us as (", "us0 as (") + """,
us as (select * from us0 where book_id is not null),
z as (select count(*) as n, count(distinct book_id) as books, count(distinct (book_id, work_title)) filter (work_title is not null) as works from us),
g as (select n, books, works, least(n, 4 * books) as target from z),
l as (select *, least(n, greatest(256, target * 6)) as pool, greatest(1, cast(ceil(target / books) as bigint)) as fallback from g)
select id, book_id, work_title, score, k <= pool as is_best, b <= fallback as is_fallback, target, greatest(3, (target * 8 + 99) // 100, (target + books - 1) // books) as book_limit, greatest(2, (target * 4 + 99) // 100, (target + works - 1) // works) as work_limit
from (select *, row_number() over (order by score desc nulls last, id) as k, row_number() over (partition by book_id order by score desc nulls last, id) as b from us), l where k <= pool or b <= fallback"""

_COMPARE = """with c as (select *, row_number() over (order by id) as n from name_candidates qualify n <= 3),
t as (select n, unnest([{'a': 'grade', 'v': grade}, {'a': 'category', 'v': category}, {'a': 'book_title', 'v': book_title}, {'a': 'quote', 'v': quote}, {'a': 'work_title', 'v': work_title}, {'a': 'first_category', 'v': first_category}, {'a': 'second_category', 'v': second_category}]) as x from c)
select x.a as attribute, max(case when n = 1 then x.v end) as n1, max(case when n = 2 then x.v end) as n2, max(case when n = 3 then x.v end) as n3 from t group by x.a"""

_QUOTA = """, k as (select *, row_number() over (partition by grade order by score desc, name) as g from best),
m as (select *, case when grade = 'A' then g <= 900 else g <= 300 end as picked from k where g <= 1200)
select name, grade, score, id, picked, row_number() over (order by picked desc, score desc, name) as place from m qualify place <= 1200"""

_MERGE = """, src2 as (select name, 0 as source, 'mined:' || name as id, id as passage_id, grade, feminine from best union all select given_name, 1, id, passage_id, grade, feminine from name_candidates),
c as (select name, list_sort(list(distinct passage_id)) as citations from src2 where passage_id is not null group by name)
select name, source, id, grade, feminine, coalesce(array_to_string(citations, ','), '') as citations from (select * from src2 qualify row_number() over (partition by name order by source desc, id) = 1) left join c using (name)"""

_ALLUSIONS = """with al as (select string_agg(raw, '' order by raw) as raw, string_agg(normalized, '' order by raw) as normal from char_aliases), """ + LEX + """,
q as (select id, translate(quote, (select raw from al), (select normal from al)) as quote from name_candidates),
u as (select id, quote, pos, unit, row_number() over (partition by id order by pos) as i from (select id, quote, pos, quote[pos] as unit from (select *, unnest(range(1, length(quote) + 1)) as pos from q)) where unit in (select unit from lx))
select distinct a.id, a.unit || b.unit as name, case when contains(a.quote, a.unit || b.unit) then 'A' else 'B' end as grade from u a join u b on a.id = b.id and b.i between a.i + 1 and a.i + 12 and a.unit <> b.unit"""

_INTERLEAVE = RAW + """,
cs as (select c, row_number() over (order by c) - 1 as k, count(*) over () as n from (select c1 as c from rp union select c2 from rp))
select name, row_number() over (partition by c1, c2 order by name) - 1 as turn, (y.k - x.k + x.n) % x.n as "offset", x.k as k1 from rp join cs x on x.c = c1 join cs y on y.c = c2"""

_REASONS = ITEMS + """,
l as (select s."user", it.item, list_transform(list_zip(weights, features, range(13)), lambda z: struct_pack(v := -z[1] * (z[2] - 0.5), i := z[3])) as x from pw s cross join it)
select "user", item, array_to_string(list_transform(list_sort(list_filter(x, lambda z: z.v < -0.04))[1:3], lambda z: 'f' || lpad(cast(z.i as varchar), 2, '0')), ',') as reasons from l"""

_SCREEN = MINED + f"""
select name, best.id, score from best join p on p.id = best.id where grade = 'A' and name[1] <> name[2] and not regexp_matches(name, '[{SCREEN_FUNCTION}]') and not regexp_matches(text, '[{SCREEN_NEGATIVE}]')
and feminine >= 4 and rarity >= 3.5 and usability >= 3.6"""

CHOICES = """fb as (select feedback_id, min(struct_pack(a := received_at, p := profile_id, l := left_name, r := right_name, c := choice, t := recorded_at)) as f from pairwise_feedback group by feedback_id),
nm as (select distinct unnest([given_name, full_name]) as name, given_name as item from name_candidates),
ch as (select f.p as profile, x.item as "left", y.item as "right", lower(regexp_replace(f.c, '^\\s+|\\s+$', '', 'g')) as choice, f.t as tm, feedback_id as seq from fb join nm x on x.name = f.l join nm y on y.name = f.r
  where f.p is not null and x.item <> y.item)"""

_PAIRWISE = "with " + CHOICES + ", fe as (select item, list(value order by k) as x from (" + _FEATURES + """) group by item),
gp as (select profile, tm, seq, choice, case when choice = 'left' then list_transform(list_zip(a.x, b.x), lambda z: z[1] - z[2]) else list_transform(list_zip(a.x, b.x), lambda z: z[2] - z[1]) end as gap
  from ch join fe a on a.item = "left" join fe b on b.item = "right" where choice in ('left', 'right', 'both-dislike')),
fo as (select profile, count(*) as n, list_reduce(list(struct_pack(w := gap) order by tm, seq) filter (choice <> 'both-dislike'),
  lambda a, s: struct_pack(w := list_transform(list_zip(a.w, s.w), lambda z: least(3.0, greatest(-3.0, 0.985 * (z[1] + z[2] * 0.4 * (1 - 1 / (1 + exp(-list_sum(list_transform(list_zip(a.w, s.w), lambda q: q[1] * q[2])))))))))),
  struct_pack(w := list_transform(range(13), lambda i: 0.0::double))).w as w from gp group by profile)
select profile, generate_subscripts(v, 1) - 1 as k, floor(unnest(v) * 1e6 + 0.5) / 1e6 as weight, progress from
  (select profile, cast(least(8, n) as int) as progress, coalesce(w, list_transform(range(13), lambda i: 0.0::double)) as v from fo)"""

_FOLD = 'select "user", generate_subscripts(weights, 1) - 1 as k, floor(unnest(weights) * 1e6 + 0.5) / 1e6 as weight, events from wt'


def statements() -> dict[str, str]:
    cited = """select query, grade, place, n, d.id, book_id, coalesce(b.title, book_id) as book_title, coalesce(b.category, '古籍') as category, work_title, chapter_title, text, source_url, verification_url
from (select query, grade, place, 0 as n, id_a as id from found union all select query, grade, place, 1, id_b from found where id_b is not null) d join p on p.id = d.id left join corpus_books b on b.id = book_id"""
    counts = ", ".join(f"count(*) filter (grade = '{g}') as n_{g.lower()}" for g in "ABCDEF")
    single = SEARCH.replace("qs as (select q as query, substr(t, 1, 1) as u1, case when length(t) > 1 then substr(t, 2, 1) end as u2", "qs as (select distinct substr(t, 1, 1) as query, substr(t, 1, 1) as u1, cast(null as varchar) as u2")
    return {
        "evidence_search": _with(SEARCH, "select * from found"),
        "evidence_citations": _with(SEARCH, cited),
        "evidence_grades": _with(SEARCH, f"select query, {counts}, count(*) filter (grade in ('A', 'B', 'C')) as n_abc, count(*) filter (grade in ('D', 'E')) as n_de from found group by query"),
        "evidence_single_unit": _with(single, "select * from found"),
        "ordinals": _with(RANKED, "select id, book_ord, work_ord, passage_ord from r"),
        "posting_build": _with(POSTINGS, "select unit, id, array_to_string(positions, ',') as positions from post"),
        "posting_rank": _with(POSTINGS, "select unit, passage_ord, rank, row_number() over (partition by unit order by rank, passage_ord) as place from post join r using (id)"),
        "alias_pairs": _with(P, "select distinct raw, normalized from char_aliases where raw <> normalized and exists (select 1 from p where contains(text, raw))"),
        "bucket_histogram": _with(POSTINGS, "select lpad(printf('%x', unicode(unit) // 256), 3, '0') as bucket, count(distinct unit) as units, sum(len(positions))::bigint as occurrences from post group by bucket"),
        "sentence_split": _with(P, rf"""select id, row_number() over (partition by id order by k) - 1 as n, sentence from (select id, k, regexp_replace(s, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g') as sentence
  from (select id, generate_subscripts(x, 1) as k, unnest(x) as s from (select id, regexp_extract_all(nfc_normalize(text), '[^{END}]+[{END}]?') as x from p))) where sentence <> ''"""),
        "search_text": _with(P, f"select id, regexp_replace(translate(nfc_normalize(text), (select raw from al), (select normal from al)), '[^{HAN}]', '', 'g') as plain from p"),
        "indexed_render": _with(P, "select id, x as rendered, length(x) as size from (select id, coalesce(array_to_string(list_transform(range(length(normalized_text)), lambda i: '[' || i || ']' || normalized_text[i + 1]), ' '), '') as x from p where normalized_text is not null)"),
        "corpus_report": _report(),
        "quality_issues": _issues(),
        "ready_gate": "select count(*) as books, count(*) filter (status = 'ready') as ready_books from corpus_books",
        "citation_verify": _citations(),
        "name_validation": f"""with {P}, {LEX} select 'TOO_FEW_UNITS' as code, cast(count(*) as varchar) as target_id from lx having count(*) < 145
  union all select 'FRAGMENT_FIELD_MISSING', id from p where {_blank('normalized_text')} or {_blank('chapter_title')}
  union all select 'DUPLICATE_NAME', given_name from name_candidates group by given_name having count(*) > 1
  union all select 'SCORE_OUT_OF_RANGE', id from name_candidates where not coalesce(feminine between 0 and 5, true) or not coalesce(rarity between 0 and 5, true) or not coalesce(usability between 0 and 5, true) or not coalesce(family_score between 0 and 5, true)""",
        "lexicon": _with(LEX, "select * from lx"),
        "mined_pairs": _with(MINED, "select * from mined"),
        "discovery_pool": _with(MINED, "select * from best"),
        "discovery_quota": "with " + MINED + _QUOTA,
        "discovery_modes": _with(MINED, "select name, grade = 'A' as a_only, feminine >= 4 and usability >= 3.5 and name[1] <> name[2] as evidence from best"),
        "rule_screen": "with " + _SCREEN,
        "hash_sample": _with(MINED, "select name, grade from best order by sha256('7:' || name) limit 24"),
        "raw_pairs": _with(RAW, "select * from rp"),
        "raw_filter": _with(RAW, "select name, feminine, usability, family from rp where feminine >= 4"),
        "interleave": "with " + _INTERLEAVE,
        "allusion_pairs": _ALLUSIONS,
        "clause_offsets": _with(CLAUSES, "select * from cl"),
        "windows": _with(WINDOWS, """select id, start, "end", text, floor(score * 1e6 + 0.5) / 1e6 as score, opportunities, array_to_string(naming, ',') as naming from win"""),
        "nameability": _with(NAMEABLE, "select id, floor(score * 1e6 + 0.5) / 1e6 as score, array_to_string(naming, ',') as naming from nb"),
        "source_filter": _with(USABLE, "select id, book_id, score from us"),
        "passage_pool": "with " + _POOL,
        "pool_merge": "with " + MINED + _MERGE,
        "culture_score": _CULTURE,
        "features_auto": _FEATURES,
        "compare_pivot": _COMPARE,
        "scenarios": """select printf('SCN-%03d', cast(row_number() over (order by d, s) as int)) as id, strftime(d, '%Y-%m-%d') as day, s as slot, (s * 2 + 23) % 24 as begins, (s * 2 + 1) % 24 as ends
  from (select unnest(generate_series(timestamp '2026-10-01', timestamp '2026-10-11', interval 1 day)) as d) cross join (select unnest(range(12)) as s)""",
        "page": _with(RAW, "select name, feminine, usability from rp order by feminine desc, usability desc, name limit 48 offset least(48, (greatest(1, (select cast(ceil(count(*) / 48) as bigint) from rp)) - 1) * 48)"),
        "pointer_resolve": _with(P, """select n.id, k - 1 as n, n.passage_id, strpos(normalized_text, given_name[k]) - 1 as place, case when strpos(normalized_text, given_name[k]) > 0 then given_name[k] end as unit,
  case when strpos(normalized_text, given_name[k]) > 0 then 0 end as occurrence from (select *, unnest(range(1, length(given_name) + 1)) as k from name_candidates) n join p on p.id = n.passage_id"""),
        "reaction_fold": _with(ITEMS, _FOLD),
        "reaction_stream": _with(ITEMS, _FOLD),
        "explicit_feedback": _with(ITEMS, "select * from ex"),
        "exposure": _with(ITEMS, 'select "user", item, shown, floor(penalty * 1e9 + 0.5) / 1e9 as penalty from pe'),
        "recent_items": _with(ITEMS, "select * from rc"),
        "list_toggles": _with(ITEMS, 'select "user", item from sh group by all having count(*) % 2 = 1'),
        "fit": _with(ITEMS, 'select "user", item, floor(fit * 1e6 + 0.5) / 1e6 as fit from ft'),
        "reasons": "with " + _REASONS,
        "item_similarity": _with(ITEMS, f"""select ra."user", a.item as a_item, b.item as b_item, floor(({_similarity('a', 'b')}) * 1e9 + 0.5) / 1e9 as similarity
  from rc ra join rc rb on ra."user" = rb."user" and ra.item < rb.item join it a on a.item = ra.item join it b on b.item = rb.item"""),
        "adaptive_next": "with " + NEXT,
        "curated_search": _with(CURATED, "select * from own union all select * from cs where id_a is not null and id_b is not null and id_a <> id_b union all select * from ds union all select * from es"),
        "stable_keys": """select event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as key from events""",
        "redacted": r"""select doc_id, md5(regexp_replace(regexp_replace(text, '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g'), '(?i)Bearer\s+[^\s"'']+', 'Bearer [REDACTED]', 'g')) as digest,
  regexp_matches(text, '\bsk-[A-Za-z0-9_-]{12,}\b') or regexp_matches(text, '(?i)Bearer\s+') as secret from documents where text is not null""",
        "pair_dedup": _with(MINED, "select name, grade, book_id, min(struct_pack(i := id, d := distance)).i as id, min(struct_pack(i := id, d := distance)).d as distance, count(*) as dropped_and_kept from mined group by name, grade, book_id"),
        "best_per_name": _with(MINED, """select name, id, distance, grade, k = 1 as kept, case when k > 1 then 'weaker than ' || best_id end as reason from (select *, row_number() over o as k, first_value(id) over o as best_id from (select *, score + case grade when 'A' then 0.15 else 0.05 end as v from mined)
  window o as (partition by name order by v desc, id, distance, grade))"""),
        "profile_lookup": """select distinct f.profile_id as profile, c.id from pairwise_feedback f join name_candidates c on f.left_name in (c.given_name, c.full_name) or f.right_name in (c.given_name, c.full_name) where f.profile_id is not null""",
        "pairwise_fold": _PAIRWISE,
        "exclusion": r"""with x as (select distinct unnest([left_name, right_name]) as name from pairwise_feedback where lower(regexp_replace(choice, '^\s+|\s+$', '', 'g')) = 'both-dislike')
select id from name_candidates where given_name not in (select name from x where name is not null) and full_name not in (select name from x where name is not null)""",
        "dimension_lists": """select 'category' as list, category as member, count(*) as n from corpus_books group by category union all select 'period', period, count(*) from corpus_books group by period
union all select 'unit category', c, count(*) from (select unnest([first_category, second_category]) as c from name_candidates) group by c""",
        "raw_ids": _with(RAW, "select name, printf('RAW-%05d', cast(k as int)) as raw_id from (select name, row_number() over (order by u1, u2) as k from rp)"),
        "unit_interleave": _with(LEX, "select unit, category, turn from (select *, row_number() over (partition by category order by unit) - 1 as turn from lx) order by turn, category limit 560"),
        "preliminary_topk": """select id, place, place <= 60 as kept from (select id, row_number() over (order by coalesce(feminine, 0) + coalesce(rarity, 0) + coalesce(usability, 0) desc, id) as place from name_candidates)""",
        "uneven_sources": _with(P, "select book_id from p group by book_id having count(distinct {'a': source_url, 'b': verification_url}) > 1"),
        "outline_sections": _with(P, f"""select work_id as book_id, row_number() over (partition by work_id order by ord, id) - 1 as n, trim(regexp_replace(work_title, '^[0-9]+\\s+', '')) as title, '卷' as chapter_title, t as text
  from (select *, regexp_replace(text, '\\s+', '', 'g') as t from p where work_title <> '') where regexp_matches(nfc_normalize(translate(t, (select raw from al), (select normal from al))), '[{HAN}]')"""),
    } | oracle_candidates.statements(MINED, P, LEX, RAW, CHOICES, ITEMS, FACTORY, _ALLUSIONS, HAN, END)
