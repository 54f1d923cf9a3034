"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from .fixtures import with_ctes

SQL: dict[str, str] = {}

#: Fixed values, written out here so that the SQL does not lean on the code it is compared with.
READER_SWAPS = [("0", "O"), ("O", "0"), ("1", "I"), ("I", "1"), ("5", "S"), ("S", "5"), ("2", "Z"), ("Z", "2"), ("8", "B"), ("B", "8")]
RANK_SWAPS = [("VV", "W"), ("W", "VV"), ("S", "C"), ("C", "S"), ("0", "O"), ("O", "0"), ("1", "I"), ("I", "1")]
PREFILTER_COLORS = {
    "연두": ["연두", "녹색", "초록", "초록색"],
    "하양": ["하양", "흰색", "백색"],
    "노랑": ["노랑", "황색"],
    "파랑": ["파랑", "청색"],
}
RANK_COLORS = {
    "주황": ["주황", "주황색", "연주황", "적주황"],
    "빨강": ["빨강", "적색", "빨간", "적"],
    "하양": ["하양", "흰색", "백색"],
    "파랑": ["파랑", "청색", "파란"],
    "노랑": ["노랑", "황색", "노란"],
    "연두": ["연두", "녹색", "초록", "초록색"],
}
ALPHABET = list("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-.")
TOK = r"'[A-Z0-9\-]{2,}'"


def up(x: str) -> str:
    return f"upper(replace(coalesce({x}, ''), 'ß', 'ss'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, {TOK})"


def flat(x: str) -> str:
    return f"replace({x}, '-', '')"


def normal(x: str, basic: bool = False) -> str:
    if basic:
        return rf"trim(regexp_replace(regexp_replace({up(x)}, '[^A-Z0-9.\-\s]+', '', 'g'), '\s+', ' ', 'g'))"
    return rf"trim(regexp_replace(regexp_replace({up(x)}, '[^A-Z0-9.\-\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def rank_norm(x: str, basic: bool = False) -> str:
    s = strip(up(x))
    return s if basic else f"replace(replace({s}, 'D-W1', 'D-W'), 'DW1', 'DW')"


def variants(s: str) -> str:
    every = [s, flat(s), f"replace({s}, ' ', '')"] + [f"replace({x}, '{a}', '{b}')" for a, b in READER_SWAPS for x in (s, flat(s))]
    ordered = f"list_sort(list_transform(list_distinct([{', '.join(every)}]), lambda x: {{'n': length(x), 's': x}}))[1:12]"
    return f"case when {s} = '' then [] else list_transform({ordered}, lambda x: x.s) end"


def _swaps(x: str) -> str:
    return "[" + ", ".join(f"replace({x}, '{a}', '{b}')" for a, b in RANK_SWAPS) + "]"


def rank_variants(s: str) -> str:
    """s: a normalised token."""
    once = f"flatten(list_transform([{s}, {flat(s)}], lambda y: {_swaps('y')}))"
    twice = f"flatten(list_transform(list_distinct({once}), lambda z: {_swaps('z')}))"
    every = f"list_concat([{s}, {flat(s)}], {once}, {twice})"
    both = f"list_concat({every}, list_transform({every}, lambda v: replace(v, '-', '')))"
    return f"list_sort(list_distinct(list_filter({both}, lambda u: length(u) >= 2)))"


def weight(t: str, basic: bool = False) -> str:
    s = rank_norm(t, basic)
    strong = f"{flat(s)} = 'DW'" if basic else f"{flat(s)} in ('DW', 'DVV')"
    return f"case when {strong} then 70 when {s} = 'PAC' then 60 else 35 end"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def shapes(g: str, stripped: bool = False) -> str:
    s = strip(g) if stripped else g
    return f"case when coalesce({g}, '') = '' then [] when {s} in ('타원형', '장방형') then ['장방형', '타원형'] else [{s}] end"


def colors(g: str, kind: str) -> str:
    names = PREFILTER_COLORS if kind == "prefilter" else RANK_COLORS
    parts = {
        "prefilter": f"string_split_regex({g}, '[+,/ ]+')",
        "rank": rf"list_filter(string_split_regex({strip(g)}, '[+,/\s]+'), lambda p: p <> '')",
        "basic": f"[{strip(g)}]",
    }[kind]
    cases = " ".join(f"when '{k}' then {_list(v)}" for k, v in names.items())
    return f"case when coalesce({g}, '') = '' then [] else list_distinct(flatten(list_transform({parts}, lambda p: case p {cases} else [p] end))) end"


def joined(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({x}), '|'), '')"


def in_list(values: str, item: str) -> str:
    return f"coalesce(list_contains({values}, {strip(item)}), false)"


def has_shape(item: str, guess: str, prefilter: bool = False) -> str:
    found = in_list(shapes(guess, not prefilter), item)
    return f"(coalesce({guess}, '') = '' or {found})" if prefilter else found


def has_color(c1: str, c2: str, guess: str, kind: str = "rank") -> str:
    found = f"({in_list(colors(guess, kind), c1)} or {in_list(colors(guess, kind), c2)})"
    return f"(coalesce({guess}, '') = '' or {found})" if kind == "prefilter" else found


CLEAN = rf"""pf1 as (
 select *, trim(regexp_replace(regexp_replace({up('imprint_raw')}, '[^A-Z0-9\-\s.]', ' ', 'g'), '\s+', ' ', 'g')) as s0 from readings),
pf2 as (select *, {toks(r"regexp_replace(replace(replace(s0, 'D-W1', 'D-W'), 'DW1', 'DW'), '\b[A-Z]?PAC[A-Z]?\b', 'PAC', 'g')")} as t from pf1),
pf3 as (select *, list_transform(t, lambda x: {flat('x')}) as k from pf2),
pf4 as (
 select *, list_transform(list_filter(t, lambda x, i: list_position(k, {flat('x')}) = i), lambda x: case when {flat('x')} = 'DW' then 'D-W' else x end) as u from pf3),
clean as (
 select reading_id, case when list_contains(u, 'D-W') and list_contains(u, 'PAC') then 'D-W PAC' when list_contains(u, 'D-W') then 'D-W'
  when list_contains(u, 'PAC') then 'PAC' else coalesce(array_to_string(u, ' '), '') end as imprint,
  coalesce(shape_guess, '') as shape_guess, coalesce(color_guess, '') as color_guess from pf4),
q as (select distinct imprint, shape_guess, color_guess from clean),
im as (select distinct imprint from q)"""

INDEX = f"""pt as (select item_idx, {toks("upper(coalesce(print_front, '') || ' ' || coalesce(print_back, ''))")} as tok from catalog),
idx as (
 select distinct token, item_idx from (
  select item_idx, unnest(tok) as token from pt union all select item_idx, unnest(list_transform(tok, lambda x: {flat('x')})) from pt) where token <> '')"""

SEEDS = f"""va as (select imprint, {variants(strip(up('imprint')))} as v from im),
qt as (select distinct imprint, unnest(flatten(list_transform(list_concat([imprint], v), lambda x: {toks('upper(x)')}))) as token from va),
seeds as (select distinct imprint, item_idx from qt join idx using (token))"""

SCORES = f"""rt as (select distinct imprint, unnest({toks(rank_norm('imprint'))}) as target from im),
tv as (select target, unnest({rank_variants('target')}) as token from (select distinct {rank_norm('target')} as target from rt)),
it as (select distinct item_idx, unnest(list_concat({toks(rank_norm('print_front'))}, {toks(rank_norm('print_back'))})) as token from catalog),
th as (select distinct imprint, item_idx, target, {flat('target')} as form, {weight('target')} as w from rt join tv using (target) join it using (token)),
ts as (
 select imprint, item_idx, cast(case when count(distinct form) = 1 and max(form) = 'PAC' then least(sum(w), 69) else sum(w) end
  + case when count(distinct form) >= 2 then 25 else 0 end as int) as text_score from th group by 1, 2)"""

FLAGS = f"""{has_shape('drug_shape', 'shape_guess')} as hs, {has_color('color_class1', 'color_class2', 'color_guess')} as hc,
 {has_shape('drug_shape', 'shape_guess', True)} as ps, {has_color('color_class1', 'color_class2', 'color_guess', 'prefilter')} as pc"""

#: Flags once for each pair of guesses and attribute class.
PAIRS = f"""gs as (select distinct shape_guess, color_guess from q),
ac as (select distinct drug_shape, color_class1, color_class2 from catalog),
fl as (select *, {FLAGS} from gs, ac),
miss as (select * from q where imprint not in (select imprint from seeds)),
pairs as (
 select q.*, c.item_idx, c.drug_shape, c.color_class1, c.color_class2, false as missed from q join seeds using (imprint) join catalog c using (item_idx)
 union all select miss.*, c.item_idx, c.drug_shape, c.color_class1, c.color_class2, true from miss, catalog c),
flagged as (
 select p.*, hs, hc, ps, pc from pairs p join fl on p.shape_guess = fl.shape_guess and p.color_guess = fl.color_guess and p.drug_shape is not distinct from fl.drug_shape
  and p.color_class1 is not distinct from fl.color_class1 and p.color_class2 is not distinct from fl.color_class2)"""


def ranked(ladder: bool) -> str:
    counts = "count_if(ps and pc) over w as strong, count_if(ps) over w as mid, count_if(pc) over w as weak"
    mode = "case when strong >= 30 then 'strong' when mid >= 30 then 'mid' when weak >= 30 then 'weak' else 'none' end" if ladder else "'single'"
    left = "mode in ('none', 'single') or (mode = 'strong' and ps and pc) or (mode = 'mid' and ps) or (mode = 'weak' and pc)"
    return f"""cn as (select *, {counts} from flagged window w as (partition by imprint, shape_guess, color_guess)),
md as (select *, {mode} as mode from cn),
lf as (select * from md where {left}),
sc as (
 select l.*, cast(case when l.imprint = '' then 25 * hs::int + 25 * hc::int + 20 * (hs and hc)::int
  else coalesce(text_score, 0) + 8 * hs::int + 8 * hc::int end as int) as score from lf l left join ts using (imprint, item_idx)),
rk as (
 select *, row_number() over (partition by imprint, shape_guess, color_guess order by score desc, item_idx) as rank from sc where score > 0 qualify rank <= 5),
modes as (select distinct imprint, shape_guess, color_guess, mode from md)"""


MATCH = f"{CLEAN},\n{INDEX},\n{SEEDS},\n{SCORES},\n{PAIRS}"
LEVEL = "case when score >= 120 then 'HIGH' when score >= 70 then 'MEDIUM' else 'LOW' end"


def catalog_readings(more: str = "") -> str:
    return with_ctes("readings", more=more)


def define(name: str, sql: str) -> None:
    SQL[name] = sql


# sources and sinks

#: A page as it lands: fields without a value are left out.
ITEM_TEXT = " || ',' || ".join(f"coalesce('\"{f.upper()}\":' || to_json({f}), '')" for f in "item_name entp_name print_front print_back color_class1 color_class2 drug_shape".split())
define(
    "read_catalog_pages",
    with_ctes("catalog", more=rf"""it as (select item_idx, '{{' || trim(regexp_replace({ITEM_TEXT}, ',+', ',', 'g'), ',') || '}}' as item from catalog),
pg as (select item_idx // 100 + 1 as page_no, '{{"header":{{"resultCode":"00","resultMsg":"OK"}},"body":{{"items":[' || string_agg(item, ',' order by item_idx) || ']}}}}' || chr(10) as payload from it group by 1)""")
    + "select page_no, true as parse_ok, length(payload) as n_chars, md5(payload) as digest from pg",
)
define("flatten_envelope", with_ctes("catalog") + "select item_idx + 1 as item_idx, item_name, entp_name, print_front, print_back, color_class1, color_class2, drug_shape from catalog")
define(
    "page_status",
    """with p as (select p_partkey // 100 + 1 as page_no, count(*) as n from part group by 1)
select page_no, case when page_no % 7 = 0 then '30' when page_no % 7 = 1 then null else '00' end as result_code,
 case when page_no % 7 = 0 then 'KEY' when page_no % 7 = 1 then null else 'OK' end as result_msg,
 case when page_no % 7 in (0, 1) then 0 else n end as n_items, page_no % 7 in (0, 1) as is_error from p""",
)
define("select_catalog_items", with_ctes("catalog") + "select item_idx, item_name, entp_name from catalog where contains(item_name, 'a') and contains(entp_name, '1')")
define("refresh_catalog", with_ctes("catalog") + "select item_idx + 1 as item_idx, item_name, print_front, print_back, 100000000.0::double as loaded_at from catalog")
define(
    "load_progress",
    """with p as (select p_partkey // 100 + 1 as page_no, count(*) as n_items from part group by 1)
select page_no, n_items, cast(sum(n_items) over (order by page_no) as bigint) as total from p""",
)
define("load_snapshot", with_ctes("catalog") + "select item_idx + 1 as item_idx, item_name, 100000000.0::double as loaded_at from catalog")
define("is_stale", with_ctes("snapshots") + "select version, coalesce(100000000.0 - loaded_at > 604800, true) as stale from snapshots")
define("snapshot_action", with_ctes("snapshots") + "select version, case when version % 3 > 0 and 100000000.0 - loaded_at <= 2592000 then 'use' else 'refresh' end as action from snapshots")
define(
    "read_images",
    """select s_suppkey, case s_suppkey % 8 when 0 then 'png' when 1 then 'jpeg' when 2 then 'webp' when 7 then 'jpeg' end as kind,
 case s_suppkey % 8 when 3 then 'suffix' when 4 then 'content' when 5 then 'decode' when 6 then 'decode' end as reason from supplier""",
)
CLASS_MAP = "cls as (select unnest(range(38))::int as class_id, unnest(" + _list(ALPHABET) + ") as ch)"
define("read_class_map", with_ctes("detections", more=CLASS_MAP) + "select class_id, ch, count(*) as n from detections join cls using (class_id) group by 1, 2")
BOXES = """nb as (
 select image_id, det_id, class_id, (x0 + x1) / 2 / 1000 as cx, (y0 + y1) / 2 / 500 as cy, (x1 - x0 + 1) / 1000 as w, (y1 - y0 + 1) / 500 as h from detections)"""
LABELS = BOXES.replace("from detections", "from label_boxes") + """,
lb as (select case when image_id % 10 = 0 then 'val' else 'train' end as split, 's' || image_id as stem, det_id as place, * from nb)"""
define("normalize_boxes", with_ctes("detections", more=BOXES) + "select image_id, det_id, class_id, round(cx, 6) as cx, round(cy, 6) as cy, round(w, 6) as w, round(h, 6) as h from nb")
define("write_yolo_labels", with_ctes("label_boxes", more=LABELS) + "select split, stem, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) as value from lb")
define(
    "read_yolo_labels",
    with_ctes("label_boxes", more=f"{CLASS_MAP},\n{LABELS}")
    + """select split, stem, cast(row_number() over (partition by split, stem order by place) - 1 as int) as line_no, class_id, ch,
 printf('%.6f', cx)::double as cx, printf('%.6f', cy)::double as cy, printf('%.6f', w)::double as w, printf('%.6f', h)::double as h
from lb join cls using (class_id)""",
)

# text

define("normalize_ocr", f"select doc_id, {normal('text')} as text from documents")
define("normalize_ocr_basic", f"select doc_id, {normal('text', basic=True)} as text from documents")
define("tokens", f"select doc_id, coalesce(array_to_string({toks(up('text'))}, '|'), '') as tokens from documents")
define("norm_token", with_ctes("catalog") + f"select item_idx, {strip(flat(up('print_front')))} as front, {strip(flat(up('print_back')))} as back from catalog")
define("print_tokens", with_ctes("catalog", more=INDEX) + "select item_idx, coalesce(array_to_string(list_filter(tok, lambda x, i: list_position(tok, x) = i), '|'), '') as tokens from pt")
define("post_fix_imprint", catalog_readings(CLEAN) + "select reading_id, imprint from clean")
define("post_fix_imprint_basic", catalog_readings() + rf"select reading_id, trim(regexp_replace(regexp_replace({up('imprint_raw')}, '[A-Z]?PAC[A-Z]?', 'PAC', 'g'), '\s+', ' ', 'g')) as imprint from readings")
define("ocr_variants", catalog_readings(f"s as (select reading_id, {strip(up('imprint_raw'))} as s from readings)") + f"select reading_id, coalesce(array_to_string({variants('s')}, '|'), '') as variants from s")
define("query_tokens", catalog_readings(f"{CLEAN},\n{INDEX},\n{SEEDS}") + "select imprint, coalesce(string_agg(token, '|' order by token), '') as tokens from im left join qt using (imprint) group by imprint")
define("rank_norm", catalog_readings() + f"select reading_id, {rank_norm('imprint_raw')} as norm, {rank_norm('imprint_raw', True)} as basic from readings")
TARGETS = f"tg as (select distinct unnest({toks(up('imprint_raw'))}) as token from readings), tn as (select token, {rank_norm('token')} as s, {rank_norm('token', True)} as b from tg)"
define("rank_variants", catalog_readings(TARGETS) + f"select token, coalesce(array_to_string({rank_variants('s')}, '|'), '') as variants, array_to_string(list_sort(list_distinct([b, {flat('b')}])), '|') as basic from tn")
define("token_weight", catalog_readings(TARGETS) + f"select token, {weight('token')} as weight, {weight('token', True)} as basic from tn")
define("shape_aliases", catalog_readings() + f"select reading_id, {joined(shapes('shape_guess'))} as prefilter, {joined(shapes('shape_guess', True))} as rank from readings")
define("color_aliases_prefilter", catalog_readings() + f"select reading_id, {joined(colors('color_guess', 'prefilter'))} as aliases from readings")
define("color_aliases_rank", catalog_readings() + f"select reading_id, {joined(colors('color_guess', 'rank'))} as aliases, {joined(colors('color_guess', 'basic'))} as basic from readings")
VIEW = "nullif(item_name, '') as item_name, nullif(entp_name, '') as entp_name, coalesce(nullif(print_front, ''), nullif(print_back, '')) as imprint, nullif(color_class1, '') as color, nullif(drug_shape, '') as shape"
define("candidate_view", with_ctes("catalog") + f"select item_idx, {VIEW} from catalog")
define(
    "pill_note",
    catalog_readings(CLEAN)
    + """select reading_id, case when imprint = '' then 'OCR 실패; ' else '' end || 'prefilter=' || ['strong', 'mid', 'weak', 'none'][reading_id % 4 + 1] as batch,
 'single' as single, case when imprint = '' then 'OCR 실패' end as basic from clean""",
)

# labels

HSV = """v1 as (select *, greatest(b, g, r) as v, greatest(b, g, r) - least(b, g, r) as d from pixels),
v2 as (
 select *, case when v = 0 then 0.0::double else 255.0::double * d / v end as sf,
  case when d = 0 then 0.0::double when v = r then 60.0::double * (g - b) / d when v = g then 120.0::double + 60.0::double * (b - r) / d
   else 240.0::double + 60.0::double * (r - g) / d end as deg from v1),
v3 as (select *, floor((case when deg < 0 then deg + 360 else deg end) / 2 + 0.5)::int as h0, floor(sf + 0.5)::int as s from v2),
hsv as (select roi_id, x, y, b, g, r, in_mask, case when h0 >= 180 then h0 - 180 else h0 end as h, s, v from v3)"""
LABEL = """case when s < 45 and v > 170 then '하양' when v < 60 then '기타' when h < 10 or h > 160 then case when s >= 120 then '빨강' else '주황' end
 when h < 30 then '주황' when h < 45 then '노랑' when h < 85 then '연두' when h < 140 then '파랑' else '기타' end"""
LABEL_EN = "case when s < 35 and v > 170 then 'WHITE' when v < 60 then 'DARK' when h >= 15 and h < 35 then 'YELLOW' when h >= 35 and h < 85 then 'GREEN' when h >= 85 and h < 130 then 'BLUE' when h >= 130 and h < 170 then 'PURPLE' else 'RED' end"
MEANS = "mm as (select roi_id, count(*) as n, avg(h) as h, avg(s) as s, avg(v) as v from hsv where in_mask group by roi_id)"
define("color_label_hsv", with_ctes("pixels", more=f"{HSV},\n{MEANS}") + f"select roi_id, {LABEL} as label from mm")
SHAPE = """case when w / (h + 1e-6) >= 2.2 then '장방형'
 when w / (h + 1e-6) < 1.25 and 4 * pi() * area / (perimeter * perimeter + 1e-6) >= 0.72 then '원형' else '타원형' end"""
define("shape_label", with_ctes("contours") + f"select image_id, box_id, {SHAPE} as batch, case when area >= 400 then {SHAPE} end as single from contours")
define("is_capsule", with_ctes("contours") + f"select image_id, box_id, {SHAPE} in ('타원형', '장방형') and h > 0 and w / h > 1.3 as is_capsule from contours")
INK = "ink as (select roi_id, coalesce(avg(abs(r - g)) filter (in_mask), avg(abs(r - g))) / 255 as ink from pixels group by roi_id)"
define("color_label_en", with_ctes("pixels", more=HSV) + f"select roi_id, {LABEL_EN} as label, count(*) as n from hsv group by 1, 2")
define(
    "shape_label_en",
    with_ctes("contours")
    + """select image_id, box_id, case when area < 200 then null when 4 * pi() * area / greatest(perimeter * perimeter, 1.0::double) > 0.75 then 'ROUND'
 when w / greatest(h, 1) > 1.6 or w / greatest(h, 1) < 0.62 then 'OBLONG' else 'OVAL' end as label from contours""",
)
define("foreground_pixel", with_ctes("pixels", more=HSV) + "select roi_id, cast(count_if(not (h >= 85 and h <= 140 and s >= 35) and v > 40) as bigint) as n from hsv group by 1")

# matching

define("build_print_index", with_ctes("catalog", more=INDEX) + "select token, item_idx from idx")
define("seed_candidates", catalog_readings(f"{CLEAN},\n{INDEX},\n{SEEDS}") + "select imprint, count(*) as n, cast(sum(item_idx) as bigint) as idx_sum from seeds group by 1")
define("seed_fallback", catalog_readings(f"{CLEAN},\n{INDEX},\n{SEEDS}") + "select imprint from im where imprint not in (select imprint from seeds)")
define("prefilter_ladder", catalog_readings(f"{MATCH},\n{ranked(True)}") + "select imprint, shape_guess, color_guess, mode, count(*) as n, cast(sum(item_idx) as bigint) as idx_sum from lf where not missed group by 1, 2, 3, 4")
#: Every candidate of every distinct query.
ALL = f"{CLEAN},\n{INDEX},\n{SEEDS},\nsp as (select q.*, c.* from q join seeds using (imprint) join catalog c using (item_idx))"
PER_QUERY = "select imprint, shape_guess, color_guess, count(*) as n"
SUMS = f"{PER_QUERY}, cast(sum(score) as bigint) as total, cast(sum(score * item_idx) as bigint) as weighed"
define("item_has_shape_all", catalog_readings(f"{ALL},\nfg as (select *, {FLAGS} from sp)") + f"{PER_QUERY}, cast(count_if(hs) as bigint) as rank, cast(count_if(ps) as bigint) as prefilter from fg group by 1, 2, 3")
define("item_has_color_all", catalog_readings(f"{ALL},\nfg as (select *, {FLAGS} from sp)") + f"{PER_QUERY}, cast(count_if(hc) as bigint) as rank, cast(count_if(pc) as bigint) as prefilter from fg group by 1, 2, 3")
define(
    "score_candidates_all",
    catalog_readings(f"{ALL},\n{SCORES},\nfg as (select *, {FLAGS} from sp)")
    + f"""{SUMS} from (select fg.*, case when imprint = '' then 25 * hs::int + 25 * hc::int + 20 * (hs and hc)::int
 else coalesce(text_score, 0) + 8 * hs::int + 8 * hc::int end as score from fg left join ts using (imprint, item_idx)) group by 1, 2, 3""",
)
define(
    "score_candidates_basic_all",
    catalog_readings(
        f"""{ALL},
bt as (select imprint, unnest({toks(strip(up('imprint')))}) as target from im),
bi as (select item_idx, list_concat({toks(strip(up('print_front')))}, {toks(strip(up('print_back')))}) as tok from catalog),
bs as (
 select imprint, item_idx, sum({weight('target', True)}) as text_score from bt join seeds using (imprint) join bi using (item_idx)
 where list_has_any([target, {flat('target')}], tok) group by 1, 2)"""
    )
    + f"""{SUMS} from (select sp.*, case when imprint = '' then 0 else coalesce(text_score, 0) + 8 * {has_shape('drug_shape', 'shape_guess')}::int
 + 8 * {has_color('color_class1', 'color_class2', 'color_guess', 'basic')}::int end as score from sp left join bs using (imprint, item_idx)) group by 1, 2, 3""",
)
for whole in ("item_has_shape", "item_has_color", "score_candidates", "score_candidates_basic"):
    SQL[whole] = SQL[f"{whole}_all"]
define("match_level", catalog_readings(f"{CLEAN},\n{SCORES}") + f"select imprint, item_idx, {LEVEL.replace('score', 'text_score')} as match_level from ts")
define("text_score_join", catalog_readings(f"{CLEAN},\n{SCORES}") + "select imprint, count(*) as n, cast(sum(text_score) as bigint) as total, cast(sum(text_score * item_idx) as bigint) as weighed from ts group by 1")
RANK = "imprint, shape_guess, color_guess, item_idx, score, rank"
define("topk_candidates", catalog_readings(f"{MATCH},\n{ranked(False)}") + f"select {RANK} from rk where not missed")
define("fallback_topk", catalog_readings(f"{MATCH},\n{ranked(True)}") + f"select mode, {RANK} from rk where missed")
VARIANTS = "coalesce(array_to_string(v, '|'), '') as ocr_variants"


def identify(ladder: bool) -> str:
    note = "case when clean.imprint = '' then 'OCR 실패; ' else '' end || 'prefilter=' || modes.mode" if ladder else "'single'"
    return (
        catalog_readings(f"{MATCH},\n{ranked(ladder)}")
        + f"""select clean.reading_id, clean.imprint as ocr_text, {VARIANTS}, nullif(clean.shape_guess, '') as shape_guess, nullif(clean.color_guess, '') as color_guess,
 {note} as note, rank, rk.item_idx, nullif(c.item_name, '') as item_name, score, case when score is not null then {LEVEL} end as match_level,
 coalesce(nullif(c.print_front, ''), nullif(c.print_back, '')) as imprint, nullif(c.color_class1, '') as color, nullif(c.drug_shape, '') as shape
from clean join va using (imprint) join modes using (imprint, shape_guess, color_guess) left join rk using (imprint, shape_guess, color_guess) left join catalog c on c.item_idx = rk.item_idx"""
    )


define("identify_batch", identify(True))
define("identify_one_batch", identify(False))
define(
    "nest_response",
    catalog_readings(f"{MATCH},\n{ranked(True)}")
    + """, per as (select imprint, shape_guess, color_guess, string_agg(item_idx::varchar, '+' order by rank) as c from rk group by 1, 2, 3),
pl as (
 select reading_id // 6 as image_id, reading_id % 6 as roi_index, imprint, reading_id % 6 || ':' || imprint || ':' || coalesce(c, '') as pill
 from clean left join per using (imprint, shape_guess, color_guess))
select image_id, count(*) as n_pills, string_agg(pill, '|' order by roi_index) as pills, arg_min(imprint, roi_index) as ocr_text from pl group by 1""",
)
define("write_results", catalog_readings(f"{MATCH},\n{ranked(True)}") + "select reading_id, 'run1' as run_id, clean.imprint as ocr_text, count(rk.item_idx) as n_candidates from clean left join rk using (imprint, shape_guess, color_guess) group by all")

# OCR

PASSES = f"""pj as (
 select roi_id, pass_no, coalesce(string_agg(text, ' ' order by line_no, text) filter (text <> '' and conf >= case when pass_no in (5, 6) then 0.20::double else 0.35::double end), '') as j,
  coalesce(string_agg(text, ' ' order by line_no, text) filter (text <> '' and conf >= 0.35::double), '') as jb from ocr_lines group by 1, 2),
ps as (select roi_id, pass_no, {normal('j')} as text, {normal('jb', True)} as basic from pj),
cs as (select roi_id, coalesce(arg_min(text, pass_no) filter (text <> ''), '') as text from ps group by 1)"""
SWEEP = rf"""an as (select roi_id, attempt_no, {normal('text')} as text from ocr_attempts),
ap as (select *, len(regexp_extract_all(text, '[A-Z0-9\-.]{{2,}}')) as nt, length(regexp_replace(text, '\s', '', 'g')) as nl from an),
ar as (select *, row_number() over (partition by roi_id order by nt desc, nl desc, attempt_no) as k from ap where nl >= 3),
sw as (select a.roi_id, coalesce(ar.text, '') as text from (select distinct roi_id from an) a left join ar on ar.roi_id = a.roi_id and k = 1)"""
define("ocr_pass_text", with_ctes("ocr_lines", more=PASSES) + "select roi_id, pass_no, text, basic from ps")
define("ocr_cascade", with_ctes("ocr_lines", more=PASSES) + "select roi_id, text from cs")
define("ocr_sweep_best", with_ctes("ocr_attempts", more=SWEEP) + "select roi_id, text from sw")
define("merge_roi_text", with_ctes("ocr_lines", more=PASSES) + f"select image_id, {normal('j', True)} as text from (select roi_id // 6 as image_id, coalesce(string_agg(text, ' ' order by roi_id) filter (text <> ''), '') as j from cs group by 1)")
# detections

SCORED = """sb as (
 select image_id, det_id as anchor_id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (x1 - x0)::double as w, (y1 - y0)::double as h, [conf, 1 - conf, abs(conf - 0.5)] as scores from detections)"""
define("detection_argmax", with_ctes("detections", more=SCORED) + "select image_id, anchor_id, cast(list_position(scores, list_max(scores)) - 1 as int) as class_id, list_max(scores) as conf from sb where list_max(scores) >= 0.55")
define("boxes_xyxy", with_ctes("detections", more=SCORED) + "select image_id, anchor_id, cx - w / 2 as x0, cy - h / 2 as y0, cx + w / 2 as x1, cy + h / 2 as y1 from sb")
#: 640 / 1280 = 0.5; the canvas rows above the image: (640 - round_even(853 * 0.5)) // 2 = 107.
UNBOX = """ub as (
 select image_id, det_id, class_id, least(greatest(x0 / 0.5::double, 0), 1279) as x0, least(greatest((y0 - 107) / 0.5::double, 0), 852) as y0,
  least(greatest(x1 / 0.5::double, 0), 1279) as x1, least(greatest((y1 - 107) / 0.5::double, 0), 852) as y1 from detections)"""
define("unletterbox", with_ctes("detections", more=UNBOX) + "select image_id, det_id, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1 from ub")
define(
    "to_char_detections",
    with_ctes("detections", more=f"{CLASS_MAP},\n{UNBOX}")
    + """, iv as (select image_id, det_id, class_id, round_even(x0, 0)::int as x0, round_even(y0, 0)::int as y0, round_even(x1, 0)::int as x1, round_even(y1, 0)::int as y1 from ub)
select image_id, det_id, ch, x0, y0, x1, y1 from iv join cls using (class_id) where x1 - x0 >= 3 and y1 - y0 >= 3""",
)
#: Runs of three or more equal characters become two; RE2 has no back references.
RUNS = "string_agg(ch, '' order by turn)"
for c in ALPHABET:
    RUNS = f"regexp_replace({RUNS}, '[{c}]{{3,}}', '{c}{c}', 'g')"


def radial(chars: str, half_w: str, half_h: str) -> str:
    """CTEs that end in rd (image_id, text); chars: rows of image_id, det_id, ch, conf and corners."""
    return (
        rf"""a as (
 select image_id, det_id, ch, conf, (y0 + y1) * 0.5::double as my, atan2((y0 + y1) * 0.5::double - {half_h}, (x0 + x1) * 0.5::double - {half_w}) as ang
 from {chars} where conf >= 0.12),
b as (
 select *, round_even(ang / radians(12.0), 0)::int as bin, row_number() over (partition by image_id order by ang, det_id) as rn, count(*) over (partition by image_id) as n from a),
s as (select image_id, coalesce(min(rn) filter (ch = 'P' and conf >= 0.30), arg_min(rn, {{'my': my, 'rn': rn}})) as start from b group by 1),
t as (select b.*, (rn - start + n) % n as turn from b join s using (image_id)),
k as (select *, row_number() over (partition by image_id, bin order by conf desc, turn) as best from t),
rd as (select image_id, """
        + RUNS
        + " as text from k where best = 1 group by 1)"
    )


#: Regions' own values: the largest contour's shape, whether it is a capsule, and which text fits.
SHAPED = f"""lc as (select *, row_number() over (partition by image_id order by area desc, box_id) as nth from contours),
sg as (select image_id as roi_id, w, h, case when area >= 400 then {SHAPE} end as shape_guess from lc where nth = 1),
cp as (select roi_id, shape_guess, coalesce(shape_guess in ('타원형', '장방형') and h > 0 and w / h > 1.3, false) as is_capsule from sg)"""


def routed(regions: str, chars: str) -> str:
    return rf"""rg as (
 select r.roi_id, color_guess, shape_guess, coalesce(is_capsule, false) as is_capsule, coalesce(cs.text, '') as c, coalesce(sw.text, '') as w, coalesce(rd.text, '') as r,
  kind = 'debossed' and not coalesce(is_capsule, false) and exists (select 1 from {chars} ch where ch.image_id = r.roi_id) as use
 from {regions} r left join cp using (roi_id) left join cs using (roi_id) left join sw using (roi_id) left join rd on rd.image_id = r.roi_id),
chosen as (
 select *, coalesce(nullif(case when use then case when length(regexp_replace(r, '\s', '', 'g')) < 3 then w else r end else c end, ''), c, '') as text from rg)"""


define("decode_radial", with_ctes("detections", more=f"{CLASS_MAP},\n{radial('detections join cls using (class_id)', '320.0', '240.0')}") + "select image_id, text from rd")
define(
    "route_imprint",
    with_ctes(
        "ocr_lines", "ocr_attempts", "detections", "contours",
        more=f"{CLASS_MAP},\n{PASSES},\n{SWEEP},\n{SHAPED},\n{radial('detections join cls using (class_id)', '320.0', '240.0')},\nki as (KINDS),\n"
        + "rk0 as (select sw.roi_id, kind, null::varchar as color_guess from sw left join ki using (roi_id)),\n" + routed("rk0", "detections"),
    )
    + "select roi_id, text from chosen",
)
QUANTILE = lambda v, q: f"({v}[floor((len({v}) - 1) * {q}::double)::int + 1] + ({v}[ceil((len({v}) - 1) * {q}::double)::int + 1] - {v}[floor((len({v}) - 1) * {q}::double)::int + 1]) * ((len({v}) - 1) * {q}::double - floor((len({v}) - 1) * {q}::double)))"
ROUNDS = "".join(f""",
c{i + 1} as (select image_id, ys, coalesce(list_avg(list_filter(ys, lambda y: y < (c1 + c2) / 2)), c1) as c1, coalesce(list_avg(list_filter(ys, lambda y: y >= (c1 + c2) / 2)), c2) as c2 from c{i})""" for i in range(10))
define(
    "decode_linear",
    "with recursive "
    + with_ctes("detections", more=CLASS_MAP)[5:].rstrip()
    + f""",
a as (
 select image_id, det_id, ch, conf, case when conf >= 0.25 or (ch = '-' and conf >= 0.12) then (x0 + x1) * 0.5::double end as cx, (y0 + y1) * 0.5::double as cy
 from detections join cls using (class_id)),
b as (select *, abs(cx - median(cx) over (partition by image_id)) as off from a),
d as (select *, off <= 3.5::double * (median(off) over (partition by image_id) + 1e-6::double) as near from b),
c0 as (select image_id, ys, {QUANTILE('ys', 0.3)} as c1, {QUANTILE('ys', 0.7)} as c2 from (select image_id, list(cy order by cy) as ys from d where near group by 1) where len(ys) >= 4){ROUNDS},
e as (select d.*, coalesce(abs(cy - least(c1, c2)) > abs(cy - greatest(c1, c2)), false) as low from d left join c10 using (image_id) where near),
f as (
 select *, low and ch <> '-' as line, row_number() over w as k, list(cx) over (w rows between unbounded preceding and unbounded following) as xs
 from e window w as (partition by image_id, low and ch <> '-' order by cx, -conf, ch = '-', low, det_id)),
g as (
 select image_id, line, ch, cx, conf, row_number() over (partition by image_id, line order by k) as k
 from f where cx between {QUANTILE('xs', 0.1)} - 25 and {QUANTILE('xs', 0.9)} + 25),
w as (
 select image_id, line, k, cx, conf, ch, '' as done from g where k = 1
 union all
 select g.image_id, g.line, g.k, case when abs(g.cx - w.cx) < 10 and g.conf <= w.conf then w.cx else g.cx end, case when abs(g.cx - w.cx) < 10 and g.conf <= w.conf then w.conf else g.conf end,
  case when abs(g.cx - w.cx) < 10 and g.conf <= w.conf then w.ch else g.ch end, case when abs(g.cx - w.cx) < 10 then w.done else w.done || w.ch end
 from w join g on g.image_id = w.image_id and g.line = w.line and g.k = w.k + 1),
t as (select image_id, line, arg_max(done || ch, k) as text from w group by 1, 2),
u as (
 select image_id, regexp_replace(replace(coalesce(max(text) filter (not line), ''), 'VV', 'W'), '^D{{2,}}', 'D') as top, translate(coalesce(max(text) filter (line), ''), '01', 'OI') as bot from t group by 1)
select i.image_id, trim(coalesce(top, '') || case when coalesce(bot, '') = '' then '' else ' ' || bot end) as text from (select distinct image_id from a) i left join u using (image_id)""",
)
define(
    "nms_boxes",
    "with recursive "
    + with_ctes("detections", more=SCORED)[5:].rstrip()
    + """,
bx as (
 select image_id, anchor_id, cast(list_position(scores, list_max(scores)) - 1 as int) as class_id, list_max(scores) as conf, cx - w / 2 as x0, cy - h / 2 as y0, cx + w / 2 as x1, cy + h / 2 as y1
 from sb where list_max(scores) >= 0.12),
rb as (select *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) as area, row_number() over (partition by image_id order by conf desc, anchor_id) as k from bx),
ov as (
 select a.image_id, a.k, b.k as before, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as met, a.area + b.area as total
 from rb a join rb b on a.image_id = b.image_id and b.k < a.k),
cf as (select rb.image_id, rb.k, list(before) filter (total - met > 0 and met / (total - met) > 0.45::double) as hit from rb left join ov using (image_id, k) group by 1, 2),
kp as (
 select image_id, k, [k] as kept from cf where k = 1
 union all
 select cf.image_id, cf.k, case when list_has_any(kept, coalesce(hit, [])) then kept else list_append(kept, cf.k) end from kp join cf on cf.image_id = kp.image_id and cf.k = kp.k + 1),
ls as (select image_id, arg_max(kept, k) as kept from kp group by 1)
select rb.image_id, anchor_id, conf, class_id, x0, y0, x1, y1 from rb join ls using (image_id) where list_contains(kept, k)""",
)


def rois(shaped: str, count: int, pad: str, order: str) -> str:
    return (
        with_ctes("contours")
        + f""", f as (
 select *, row_number() over (partition by image_id order by w * h desc, box_id) as k from contours where area >= img_w * img_h * 0.01 and {shaped}),
p as (select *, floor({pad} * greatest(w, h))::int as pad from f where k <= {count}),
o as (select *, greatest(0, x - pad) as x2, greatest(0, y - pad) as y2 from p)
select image_id, row_number() over (partition by image_id order by {order}) as roi_index, x2::bigint as x, y2::bigint as y,
 (least(img_w, x2 + w + 2 * pad) - x2)::bigint as w, (least(img_h, y2 + h + 2 * pad) - y2)::bigint as h from o"""
    )


define("select_rois", rois("w >= 80 and h >= 80 and w / (h + 1e-6) between 0.18 and 5.5", 6, "0.10::double", "x2, k"))
define("select_rois_basic", rois("w >= 120 and h >= 60 and w / (h + 1e-6) between 1.1 and 7.0", 3, "0.12::double", "k"))
define(
    "auto_crop_box",
    with_ctes("contours")
    + """, f as (select *, row_number() over (partition by image_id order by area desc, box_id) as k from contours),
g as (select *, floor(0.08::double * greatest(w, h))::int as pad, row_number() over (partition by image_id order by k) as first from f where k <= 5 and area >= img_w * img_h * 0.02 and w * h <= img_w * img_h * 0.9)
select i.image_id, coalesce(greatest(0, x - pad), 0)::bigint as x0, coalesce(greatest(0, y - pad), 0)::bigint as y0,
 coalesce(least(img_w, x + w + pad), 1600)::bigint as x1, coalesce(least(img_h, y + h + pad), 1200)::bigint as y1
from (select distinct image_id from contours) i left join (select * from g where first = 1) using (image_id)""",
)
define(
    "text_union_box",
    with_ctes("contours")
    + """, u as (select image_id, min(x) filter (area >= 60) as xs, min(y) filter (area >= 60) as ys, max(x + w) filter (area >= 60) as xe, max(y + h) filter (area >= 60) as ye from contours group by 1),
p as (select *, floor(0.12::double * greatest(xe - xs, ye - ys))::int as pad, coalesce(xe > xs and ye > ys, false) as found from u)
select image_id, case when found then greatest(0, xs - pad) else 80 end::bigint as x0, case when found then greatest(0, ys - pad) else 240 end::bigint as y0,
 case when found then least(1600, xe + pad) else 1520 end::bigint as x1, case when found then least(1200, ye + pad) else 1020 end::bigint as y1 from p""",
)

# pixels

define("bgr_to_hsv", with_ctes("pixels", more=HSV) + "select roi_id, sum(h)::bigint as h, sum(s)::bigint as s, sum(v)::bigint as v from hsv group by 1")
define(
    "mask_mean_color",
    with_ctes("pixels", more=f"{HSV},\n{MEANS}")
    + f"select roi_id, n, round(h, 6) as h, round(s, 6) as s, round(v, 6) as v, label, case when n >= 200 and label <> '기타' then label end as single from (select *, {LABEL} as label from mm)",
)
define(
    "capsule_half_colors",
    with_ctes("pixels", more=HSV)
    + f""", hm as (select roi_id, (x >= 50)::int as half, count(*) as n, avg(h) as h, avg(s) as s, avg(v) as v from hsv where in_mask group by 1, 2),
hl as (select roi_id, half, n, {LABEL} as label from hm),
hd as (select roi_id, label, min(half) as half from hl where n >= 200 and label <> '기타' group by 1, 2)
select r.roi_id, coalesce(string_agg(label, '+' order by half), '기타') as color from (select distinct roi_id from hm) r left join hd using (roi_id) group by 1""",
)
define("center_mean_hsv", with_ctes("pixels", more=HSV) + f"select roi_id, round(h, 6) as h, round(s, 6) as s, round(v, 6) as v, {LABEL_EN} as label from (select roi_id, avg(h) as h, avg(s) as s, avg(v) as v from hsv where x >= 25 and x < 75 and y >= 20 and y < 60 group by 1)")
define(
    "mask_tight_box",
    with_ctes("pixels")
    + """, m as (
 select roi_id, count_if(k) as n, min(x) filter (k) as xs, min(y) filter (k) as ys, max(x) filter (k) as xe, max(y) filter (k) as ye
 from (select *, in_mask and x > roi_id % 60 and y < 70 as k from pixels) group by 1),
p as (select *, floor(0.10::double * greatest(xe - xs + 1, ye - ys + 1))::int as pad from m)
select roi_id, case when n < 50 then 0 else greatest(0, xs - pad) end::bigint as x0, case when n < 50 then 0 else greatest(0, ys - pad) end::bigint as y0,
 case when n < 50 then 100 else least(100, xe + 1 + pad) end::bigint as x1, case when n < 50 then 80 else least(80, ye + 1 + pad) end::bigint as y1 from p""",
)
DEBOSS = """cl as (
 select roi_id, x, y, max(round_even(r * 0.299::double + g * 0.587::double + b * 0.114::double, 0)::int) as v, max(in_mask::int) as m from pixels group by 1, 2, 3),
gd as (
 select i.roi_id, xs.x, ys.y, coalesce(v, 0) as v, coalesce(m, 0) as m
 from (select distinct roi_id from cl) i, (select unnest(range(100)) as x) xs, (select unnest(range(80)) as y) ys left join cl on cl.roi_id = i.roi_id and cl.x = xs.x and cl.y = ys.y),
ro as (
 select *, coalesce(lead(v) over w, lag(v) over w) - coalesce(lag(v) over w, lead(v) over w) as dx, coalesce(lead(v) over w, lag(v) over w) + 2 * v + coalesce(lag(v) over w, lead(v) over w) as sx
 from gd window w as (partition by roi_id, y order by x)),
so as (
 select roi_id, m, coalesce(lag(dx) over w, lead(dx) over w) + 2 * dx + coalesce(lead(dx) over w, lag(dx) over w) as across, coalesce(lead(sx) over w, lag(sx) over w) - coalesce(lag(sx) over w, lead(sx) over w) as down
 from ro window w as (partition by roi_id, x order by y)),
db as (select roi_id, coalesce(avg(sqrt(across * across + down * down)) filter (m > 0), avg(sqrt(across * across + down * down))) / 255 as deboss from so group by 1)"""
define("deboss_score", with_ctes("pixels", more=DEBOSS) + "select roi_id, round(deboss, 6) as deboss from db")
define("imprint_type", with_ctes("pixels", more=f"{INK},\n{DEBOSS}") + "select roi_id, case when ink > 0.08 then 'printed' when deboss > 0.20 then 'debossed' else 'unknown' end as kind from ink join db using (roi_id)")
#: The pixel table as an image of 100 times 80: of doubled pixels the greatest colour counts, missing ones are black.
GRID = """ce as (select roi_id, x, y, max(b * 65536 + g * 256 + r) as c, max(in_mask::int) as m from pixels group by 1, 2, 3),
gr as (
 select i.roi_id, xs.x, ys.y, coalesce(c, 0) // 65536 as b, coalesce(c, 0) // 256 % 256 as g, coalesce(c, 0) % 256 as r, coalesce(m, 0) as m, coalesce(m, 0) > 0 as in_mask
 from (select distinct roi_id from ce) i, (select unnest(range(100)) as x) xs, (select unnest(range(80)) as y) ys left join ce on ce.roi_id = i.roi_id and ce.x = xs.x and ce.y = ys.y),
gd as (select *, round_even(r * 0.299::double + g * 0.587::double + b * 0.114::double, 0)::int as v from gr),
"""
define(
    "region_features",
    with_ctes("pixels", more=GRID + HSV.replace("from pixels", "from gr") + ",\n" + DEBOSS[DEBOSS.index("ro as (") :])
    + f""",
ps as (
 select roi_id, h, s, v, part from hsv, (select unnest(['mask', 'left', 'right', 'mid']) as part) p
 where (part = 'mask' and in_mask) or (part = 'left' and in_mask and x < 50) or (part = 'right' and in_mask and x >= 50)
  or (part = 'mid' and x >= 25 and x < 75 and y >= 20 and y < 60)),
me as (select roi_id, part, count(*) as n, avg(h) as h, avg(s) as s, avg(v) as v from ps group by 1, 2),
la as (select roi_id, part, case when n >= 200 and {LABEL} <> '기타' then {LABEL} end as sure, {LABEL_EN} as middle from me),
bo as (
 select roi_id, count_if(m > 0) as n, min(x) filter (m > 0) as xs, min(y) filter (m > 0) as ys, max(x) filter (m > 0) as xe, max(y) filter (m > 0) as ye,
  coalesce(avg(abs(r - g)) filter (m > 0), avg(abs(r - g))) / 255 as ink from gr group by 1),
pa as (select *, floor(0.10::double * greatest(xe - xs + 1, ye - ys + 1)) as pad from bo),
co as (
 select roi_id, max(sure) filter (part = 'mask') as color, max(sure) filter (part = 'left') as l, max(sure) filter (part = 'right') as r,
  max(middle) filter (part = 'mid') as middle from la group by 1)
select pa.roi_id, n, color,
 case when l is null and r is null then '기타' when l is null or l = r then r when r is null then l else l || '+' || r end as halves, middle,
 case when n < 50 then 0 else greatest(0, xs - pad) end::bigint as x0, case when n < 50 then 0 else greatest(0, ys - pad) end::bigint as y0,
 case when n < 50 then 100 else least(100, xe + 1 + pad) end::bigint as x1, case when n < 50 then 80 else least(80, ye + 1 + pad) end::bigint as y1,
 round(ink, 6) as ink, round(deboss, 6) as deboss,
 case when ink > 0.08 then 'printed' when deboss > 0.20 then 'debossed' else 'unknown' end as kind
from pa join co using (roi_id) join db using (roi_id)""",
)
define("ink_score", with_ctes("pixels", more=INK) + "select roi_id, round(ink, 6) as ink from ink")

SQL["route_imprint"] = SQL["route_imprint"].replace("KINDS", SQL["imprint_type"])
define(
    "identify_single",
    with_ctes(
        "catalog", "ocr_lines", "ocr_attempts", "detections", "contours",
        more=f"{CLASS_MAP},\n{PASSES},\n{SWEEP},\n{SHAPED},\nki as ({SQL['imprint_type']}),\nmc as ({SQL['mask_mean_color']}),\nkb as ({SQL['nms_boxes']}),\n"
        + """uc as (
 select image_id, anchor_id as det_id, class_id, conf, round_even(least(greatest(x0 / 0.5::double, 0), 1279), 0) as x0, round_even(least(greatest((y0 - 107) / 0.5::double, 0), 852), 0) as y0,
  round_even(least(greatest(x1 / 0.5::double, 0), 1279), 0) as x1, round_even(least(greatest((y1 - 107) / 0.5::double, 0), 852), 0) as y1 from kb),
ic as (select * from uc join cls using (class_id) where x1 - x0 >= 3 and y1 - y0 >= 3),
"""
        + radial("ic", "640.0", "426.5") + ",\nrk0 as (select ki.roi_id, kind, mc.single as color_guess from ki left join mc using (roi_id)),\n" + routed("rk0", "ic")
        + ",\nreadings as (select roi_id as reading_id, text as imprint_raw, shape_guess, color_guess from chosen),\n" + f"{MATCH},\n{ranked(False)}",
    )
    + SQL["identify_one_batch"][SQL["identify_one_batch"].index("select clean.reading_id, clean.imprint as ocr_text") :].replace("as shape\n", "as shape, is_capsule\n").replace("from clean join va", "from clean join (select roi_id as reading_id, is_capsule from chosen) using (reading_id) join va"),
)

# label corpus


def draw(key: str, what: str, n: str) -> str:
    return f"('0x' || substr(md5('0|' || ({what})::varchar || '|' || {key}::varchar), 1, 13))::bigint % ({n})"


define(
    "synth_tokens",
    catalog_readings().rstrip()
    + f""", ln as (select reading_id as id, [2, 3, 3, 4, 4, 5, 6][{draw('reading_id', '-1', '7')} + 1] as n from readings),
pl as (select id, n, array_to_string(list_transform(range(n), lambda i: {_list(ALPHABET[:36])}[{draw('id', 'i', '36')} + 1]), '') as plain from ln),
hy as (select *, n >= 3 and {draw('id', '-2', '1000000')} < 180000 as hyphen, case when n >= 3 then 1 + {draw('id', '-3', 'n - 2')} else 1 end as k from pl)
select id, case when hyphen then substr(plain, 1, k) || '-' || substr(plain, k + 1) else plain end as token from hy""",
)
define("assign_split", catalog_readings() + f"select case when {draw('reading_id', '-4', '1000000')} < 900000 then 'train' else 'val' end as split, count(*) as n from readings group by 1")
