"""Registered queries that run the function library, a namespace each: one line a column, in the language and for DuckDB.

A line is ``name form = text = DuckDB's text``. The form says how both sides are shown: ``b`` as it is, ``i`` as a whole
number, ``n`` rounded, ``s`` as text, ``l`` a list of whole numbers, ``w`` a list of texts, ``t`` a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources import load_model

_SPARK = {
    "b": "{0}", "i": "cast({0} as bigint)", "n": "round(cast({0} as double), 5) + 0D", "s": "string({0})", "l": "array_join(transform({0}, e -> string(cast(e as bigint))), ',')",
    "w": "array_join({0}, ',')", "t": "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
}
_DUCK = {
    "b": "{0}", "i": "({0})::BIGINT", "n": "round(({0})::DOUBLE, 5) + 0", "s": "({0})::VARCHAR", "l": "array_to_string(list_transform({0}, lambda e: e::BIGINT), ',')",
    "w": "array_to_string({0}, ',')", "t": "strftime(({0})::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f')",
}
_LISTS = "(SELECT k, array::sort(q) AS q FROM (SELECT l_orderkey AS k, l_linenumber AS q FROM lineitem GROUP BY k))"
_DUCK_LISTS = "(SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS q FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3)"

#: name: tables, what the text selects from, DuckDB's FROM, the key, the lines.
NAMESPACES = {
    "fn_array_all": ("lineitem", f"{_LISTS} WHERE array::len(q) > 3", _DUCK_LISTS, "k", """
all b = array::all(q, |$e| $e < 5) = len(list_filter(q, lambda e: e < 5)) = len(q)
empty b = array::is_empty(array::filter(q, |$e| $e > 5)) = len(list_filter(q, lambda e: e > 5)) = 0
matches b = array::matches(q, 1) = len(list_filter(q, lambda e: e = 1)) = len(q)
added l = array::add(array::add(q, 3), 9) = list_append(CASE WHEN list_contains(q, 3) THEN q ELSE list_append(q, 3) END, 9)
appended l = array::append(q, 9) = list_append(q, 9)
pushed l = array::push(q, 8) = list_append(q, 8)
prepended l = array::prepend(q, 0) = list_prepend(0, q)
combined i = array::len(array::combine(q, q)) = len(q) * len(q)
paired i = math::sum(array::flatten(array::combine(q, [10]))) = list_sum(q) + 10 * len(q)
filled l = array::fill(q, 0, 1, 3) = list_transform(q, lambda e, i: CASE WHEN i IN (2, 3) THEN 0 ELSE e END)
inserted l = array::insert(q, 7, 1) = q[1:1] || [7] || q[2:]
removed l = array::remove(q, 0) = q[2:]
removed_last l = array::remove(q, -1) = q[1:len(q) - 1]
reversed l = array::reverse(q) = list_reverse(q)
shuffled l = array::sort(array::shuffle(q)) = q
rising l = array::sort::asc(array::reverse(q)) = q
falling l = array::sort::desc(q) = list_reverse_sort(q)
swapped l = array::swap(q, 0, 2) = [q[3], q[2], q[1]] || q[4:]
found i = array::find(q, |$e| $e > 2) = list_filter(q, lambda e: e > 2)[1]
popped i = array::pop(q) = q[-1]
flat l = array::flatten([q, [8]]) = q || [8]
spread l = array::range(2, 3) = [2, 3, 4]
text s = array::join(q, '-') = array_to_string(q, '-')
few l = array::filter(q, |$e| $e > 2) = list_filter(q, lambda e: e > 2)
grouped l = array::sort(array::group([q, [1, 9]])) = list_sort(list_distinct(q || [1, 9]))
windows i = array::len(array::windows(q, 2)) = len(q) - 1
window l = array::at(array::windows(q, 2), 1) = q[2:3]
united l = array::sort(array::union(q, [2, 9])) = list_sort(list_distinct(q || [2, 9]))
shared l = array::sort(array::intersect(q, [2, 3, 9])) = list_sort(list_intersect(q, [2, 3, 9]))
without l = array::complement(q, [2]) = list_filter(q, lambda e: e <> 2)
most i = array::max(q) = list_max(q)
least i = array::min(q) = list_min(q)
product n = math::product(array::remove(q, 0)) = list_product(q[2:])
mode i = math::mode(array::append(array::distinct(q), array::max(q))) = list_max(q)
rank i = math::nearestrank(q, 0.5) = q[ceil(0.5 * len(q))::INT]
bottom l = math::bottom(q, 2) = q[1:2]
top l = math::top(q, 2) = list_reverse_sort(q)[1:2]
quartiles n = math::interquartile(q) = list_aggregate(q, 'quantile_cont', 0.75) - list_aggregate(q, 'quantile_cont', 0.25)
"""),
    "fn_math_all": ("part", "part", "part", "p_partkey", """
acos n = math::acos(p_size / 100) = acos(p_size / 100)
acot n = math::acot(p_size) = pi() / 2 - atan(p_size)
asin n = math::asin(p_size / 100) = asin(p_size / 100)
atan n = math::atan(p_size) = atan(p_size)
ceil n = math::ceil(p_retailprice) = ceil(p_retailprice)
floor n = math::floor(p_retailprice) = floor(p_retailprice)
cos n = math::cos(p_size) = cos(p_size)
cot n = math::cot(p_size) = cot(p_size)
ln n = math::ln(p_size) = ln(p_size)
log10 n = math::log10(p_size) = log10(p_size)
log2 n = math::log2(p_size) = log2(p_size)
deg n = math::rad2deg(p_size) = degrees(p_size)
rad n = math::deg2rad(p_size) = radians(p_size)
sign n = math::sign(p_size - 25) = sign(p_size - 25)
sin n = math::sin(p_size) = sin(p_size)
tan n = math::tan(p_size) = tan(p_size)
turned n = math::lerpangle(p_size, 350, 0.25) = p_size + (((350 - p_size + 540) % 360 + 360) % 360 - 180) * 0.25
e n = math::e = exp(1)
pi n = math::pi = pi()
inf b = math::inf > p_size = true
neg_inf b = math::neg_inf < p_size = true
tau n = math::tau = 2 * pi()
ln_10 n = math::ln_10 = ln(10)
ln_2 n = math::ln_2 = ln(2)
log10_2 n = math::log10_2 = log10(2)
log10_e n = math::log10_e = log10(exp(1))
log2_10 n = math::log2_10 = log2(10)
log2_e n = math::log2_e = log2(exp(1))
f1 n = math::frac_1_pi = 1 / pi()
f2 n = math::frac_1_sqrt_2 = 1 / sqrt(2)
f3 n = math::frac_2_pi = 2 / pi()
f4 n = math::frac_2_sqrt_pi = 2 / sqrt(pi())
f5 n = math::frac_pi_2 = pi() / 2
f6 n = math::frac_pi_3 = pi() / 3
f7 n = math::frac_pi_4 = pi() / 4
f8 n = math::frac_pi_6 = pi() / 6
f9 n = math::frac_pi_8 = pi() / 8
root n = math::sqrt_2 = sqrt(2)
"""),
    "fn_object_all": ("customer", "customer", "customer", "c_custkey", """
keys w = object::keys({ a: c_name, b: c_mktsegment }) = ['a', 'b']
vals w = object::values({ a: c_name, b: c_mktsegment }) = [c_name, c_mktsegment]
mixed w = object::values({ a: c_name, b: c_custkey }) = [c_name, c_custkey::VARCHAR]
len i = object::len({ a: c_name, b: c_mktsegment, c: 1 }) = 3
empty b = object::is_empty({ a: c_name }) = false
pair w = array::at(object::entries({ a: c_name, b: c_custkey }), 1) = ['b', c_custkey::VARCHAR]
made w = object::values(object::from_entries([['x', c_name], ['y', c_custkey]])) = [c_name, c_custkey::VARCHAR]
made_keys w = object::keys(object::from_entries([['x', 1], ['y', 2]])) = ['x', 'y']
"""),
    "fn_duration_all": ("customer", "customer", "customer", "c_custkey", """
days i = duration::days(duration::from::hours(c_custkey)) = c_custkey // 24
hours i = duration::hours(duration::from::days(c_custkey)) = c_custkey * 24
micros i = duration::micros(duration::from::millis(c_custkey)) = c_custkey * 1000
millis i = duration::millis(duration::from::micros(c_custkey)) = c_custkey // 1000
mins i = duration::mins(duration::from::secs(c_custkey)) = c_custkey // 60
nanos i = duration::nanos(duration::from::nanos(c_custkey * 1000)) = c_custkey * 1000
secs i = duration::secs(duration::from::mins(c_custkey)) = c_custkey * 60
weeks i = duration::weeks(duration::from::days(c_custkey)) = c_custkey // 7
years i = duration::years(duration::from::weeks(c_custkey)) = c_custkey * 7 // 365
"""),
    "fn_string_all": ("customer", "customer", "customer", "c_custkey", r"""
ends b = string::ends_with(c_name, '7') = suffix(c_name, '7')
joined s = string::join('/', c_name, c_mktsegment) = concat_ws('/', c_name, c_mktsegment)
low s = string::lowercase(c_name) = lower(c_name)
matches b = string::matches(c_name, '[0-9]*5[0-9]*$') = regexp_matches(c_name, '[0-9]*5[0-9]*$')
trimmed s = string::trim(string::concat('  ', c_name, ' ')) = c_name
words w = string::words(string::concat(' ', c_mktsegment, '  b c ')) = [c_mktsegment, 'b', 'c']
host s = parse::email::host(string::concat('u', <string> c_custkey, '@mail.org')) = 'mail.org'
who s = parse::email::user(string::concat('u', <string> c_custkey, '@mail.org')) = 'u' || c_custkey
domain s = parse::url::domain(string::concat('https://h', <string> c_custkey, '.org:8080/p?q=1#f')) = 'h' || c_custkey || '.org'
fragment s = parse::url::fragment(string::concat('https://h.org:8080/p?q=1#f', <string> c_custkey)) = 'f' || c_custkey
query s = parse::url::query(string::concat('https://h.org:8080/p?q=', <string> c_custkey)) = 'q=' || c_custkey
port i = parse::url::port('https://h.org:8080/p?q=1') = 8080
decoded s = <string> encoding::base64::decode(encoding::base64::encode(c_name)) = c_name
terms w = search::analyze('simple', string::concat(c_mktsegment, ', b-C')) = [lower(c_mktsegment), 'b', 'c']
id s = meta::id(string::concat('a:', c_name)) = c_name
sha512 i = string::len(crypto::sha512(c_name)) = 128
"""),
    "fn_time_all": ("events", "events", "events", "event_id", """
ceil t = time::ceil(ts, 1h) = CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END
round t = time::round(ts, 1h) = date_trunc('hour', ts + INTERVAL 30 MINUTE)
grouped t = time::group(ts, 'month') = date_trunc('month', ts)
hour i = time::hour(ts) = hour(ts)
micros i = time::micros(ts) = epoch_us(ts)
millis i = time::millis(ts) = epoch_us(ts) // 1000
minute i = time::minute(ts) = minute(ts)
nano i = time::nano(ts) = epoch_us(ts) * 1000
second i = time::second(ts) = second(ts)
last t = time::max([ts, time::floor(ts, 1d)]) = ts
first t = time::min([ts, time::floor(ts, 1d)]) = date_trunc('day', ts)
of_micros t = time::from::micros(event_id * 1000) = make_timestamp(event_id * 1000)
of_millis t = time::from::millis(event_id) = make_timestamp(event_id * 1000)
of_nanos t = time::from::nanos(event_id * 1000000) = make_timestamp(event_id * 1000)
of_secs t = time::from::secs(event_id) = make_timestamp(event_id * 1000000)
of_unix t = time::from::unix(event_id) = make_timestamp(event_id * 1000000)
of_ulid t = time::from::ulid('01ARZ3NDEKTSV4RRFFQ69G5FAV') = TIMESTAMP '2016-07-30 23:54:10.259'
of_uuid t = time::from::uuid('017f22e2-79b0-7cc3-98c4-dc0c0c07398f') = TIMESTAMP '2022-02-22 19:22:22'
now b = time::now() > ts = true
zone s = time::timezone() = 'UTC'
"""),
    "fn_type_all": ("customer", "customer", "customer", "c_custkey", """
arr l = type::array(c_custkey) = [c_custkey]
yes b = type::bool('true') = true
bytes s = <string> type::bytes(c_name) = c_name
moment t = type::datetime('2024-05-06T07:08:09Z') = TIMESTAMP '2024-05-06 07:08:09'
exact n = type::decimal('12.5') = 12.5
span i = duration::mins(type::duration('1h30m')) = 90
field s = type::field('c_name') = c_name
fields s = object::values(type::fields(['c_name', 'c_mktsegment'])) = '[' || c_name || ', ' || c_mktsegment || ']'
float n = type::float('2.5') = 2.5
number n = type::number('3') = 3
point n = math::sum(type::point([1, 2]).coordinates) = 3
range i = type::range([1, 5]).end = 5
record s = type::record('a:1').tb = 'a'
table s = type::table('person') = 'person'
thing s = type::thing('a', c_custkey).id = c_custkey::VARCHAR
uuid s = type::uuid('017F22E2-79B0-7CC3-98C4-DC0C0C07398F') = '017f22e2-79b0-7cc3-98c4-dc0c0c07398f'
is_array b = type::is::array([c_custkey]) = true
no_array b = type::is::array(c_custkey) = false
is_bool b = type::is::bool(c_custkey > 5) = true
no_bool b = type::is::bool(c_name) = false
is_bytes b = type::is::bytes(type::bytes(c_name)) = true
no_bytes b = type::is::bytes(c_name) = false
is_moment b = type::is::datetime(c_name) = false
is_decimal b = type::is::decimal(type::decimal('1.5')) = true
no_decimal b = type::is::decimal(c_custkey) = false
is_span b = type::is::duration(1h) = true
no_span b = type::is::duration(c_custkey) = false
is_float b = type::is::float(type::float(c_custkey)) = true
no_float b = type::is::float(c_custkey) = false
is_int b = type::is::int(c_custkey) = true
no_int b = type::is::int(c_name) = false
is_none b = type::is::none(c_name) = c_name IS NULL
is_null b = type::is::null(NULL) = true
no_number b = type::is::number(c_name) = false
is_object b = type::is::object({ a: 1 }) = true
no_object b = type::is::object(c_name) = false
no_string b = type::is::string(c_custkey) = false
is_uuid b = type::is::uuid('017f22e2-79b0-7cc3-98c4-dc0c0c07398f') = true
no_uuid b = type::is::uuid(c_name) = false
is_record b = type::is::record('customer:1') = true
is_user b = type::is::record('customer:1', 'user') = false
no_record b = type::is::record(c_name) = false
is_point b = type::is::point(type::point([1, 2])) = true
no_point b = type::is::point(c_custkey) = false
is_line b = type::is::line({ type: 'LineString', coordinates: [[1, 2], [3, 4]] }) = true
no_line b = type::is::line(c_name) = false
is_polygon b = type::is::polygon({ type: 'Polygon', coordinates: [[[1, 2], [3, 4], [1, 2]]] }) = true
no_polygon b = type::is::polygon(type::point([1, 2])) = false
is_points b = type::is::multipoint({ type: 'MultiPoint', coordinates: [[1, 2]] }) = true
no_points b = type::is::multipoint(c_custkey) = false
is_lines b = type::is::multiline({ type: 'MultiLineString', coordinates: [[[1, 2], [3, 4]]] }) = true
no_lines b = type::is::multiline(c_custkey) = false
is_polygons b = type::is::multipolygon({ type: 'MultiPolygon', coordinates: [[[[1, 2], [3, 4], [1, 2]]]] }) = true
no_polygons b = type::is::multipolygon(c_custkey) = false
is_collection b = type::is::collection({ type: 'GeometryCollection', geometries: [] }) = true
no_collection b = type::is::collection(c_name) = false
is_geometry b = type::is::geometry(type::point([1, 2])) = true
no_geometry b = type::is::geometry({ type: 'Circle' }) = false
"""),
    "fn_vector_all": ("embeddings", "embeddings", "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", "vec_id", """
added n = math::sum(vector::add(embedding, $v)) = list_sum(list_transform(e, lambda x: x + 0.5))
less n = math::sum(vector::subtract(embedding, $v)) = list_sum(list_transform(e, lambda x: x - 0.5))
times n = math::sum(vector::multiply(embedding, $v)) = list_sum(list_transform(e, lambda x: x * 0.5))
over n = math::sum(vector::divide(embedding, $v)) = list_sum(list_transform(e, lambda x: x / 0.5))
angle n = vector::angle(embedding, $v) = acos(list_cosine_similarity(e, list_transform(e, lambda x: 0.5::DOUBLE)))
cross n = math::sum(vector::cross(array::slice(embedding, 0, 3), [1, 2, 3])) = (e[2] * 3 - e[3] * 2) + (e[3] - e[1] * 3) + (e[1] * 2 - e[2])
project n = math::sum(vector::project(embedding, $v)) = list_sum(e)
unit n = vector::magnitude(vector::normalize(embedding)) = 1
scaled n = math::sum(vector::scale(embedding, 3)) = list_sum(e) * 3
chebyshev n = vector::distance::chebyshev(embedding, $v) = list_max(list_transform(e, lambda x: abs(x - 0.5)))
euclidean n = vector::distance::euclidean(embedding, $v) = list_distance(e, list_transform(e, lambda x: 0.5::DOUBLE))
hamming i = vector::distance::hamming(embedding, $v) = len(list_filter(e, lambda x: x <> 0.5))
minkowski n = vector::distance::minkowski(embedding, $v, 3) = pow(list_sum(list_transform(e, lambda x: pow(abs(x - 0.5), 3))), 1 / 3)
jaccard n = vector::similarity::jaccard([1, 2, 3], [2, 3, 4]) = 0.5
pearson n = vector::similarity::pearson(embedding, vector::scale(embedding, 2)) = 1
"""),
    "fn_rand_shape": ("nation", "nation", "nation", "n_nationkey", """
unit b = rand() >= 0 AND rand() < 1 = true
coin b = rand::bool() IN [true, false] = true
pick b = rand::enum(1, 2, 3) IN [1, 2, 3] = true
float b = type::is::float(rand::float(2, 3)) = true
range b = math::clamp(rand::float(2, 3), 2, 3) >= 2 = true
whole b = rand::int(4, 4) = 4 = true
v4 b = type::is::uuid(rand::uuid::v4()) = true
any b = type::is::uuid(rand::uuid()) = true
v7 b = type::is::uuid(rand::uuid::v7()) = true
v7_mark s = string::slice(rand::uuid::v7(), 14, 1) = '7'
ulid i = string::len(rand::ulid()) = 26
slept b = type::is::null(sleep(1)) = true
db s = session::db() = 'default'
ns s = session::ns() = 'spark_catalog'
many b = count(n_name) >= 0 = true
not b = not(n_nationkey > 3) = NOT (n_nationkey > 3)
"""),
}


def _lines(text: str) -> list[tuple[str, str, str, str]]:
    """(name, form, text, DuckDB's text) of each line. The last `` = `` outside of brackets parts the texts, or the one
    before DuckDB's own comparison, which is the second of three."""
    out = []
    for line in text.strip().splitlines():
        head, rest = line.split(" = ", 1)
        name, form = head.split()
        depth, cuts = 0, []
        for i, c in enumerate(rest):
            depth += (c in "([{") - (c in ")]}")
            if not depth and rest.startswith(" = ", i):
                cuts.append(i)
        at = cuts[0] if name != "whole" else cuts[1]
        out.append((name, form, rest[:at], rest[at + 3 :]))
    return out


def _query(tables: str, source: str, key: str, lines: list) -> Callable[[SparkSession, str], DataFrame]:
    text = f"SELECT {key}, {', '.join(f'{sql} AS f_{name}' for name, _, sql, _ in lines)} FROM {source}"
    shown = [key, *(f"{_SPARK[form].format(f'f_{name}')} AS f_{name}" for name, form, *_ in lines)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load_model(spark, sf_dir, (tables,)).query(text, v=[0.5] * 64).selectExpr(*shown)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name, (_tables, _source, _duck, _key, _text) in NAMESPACES.items():
    _all = _lines(_text)
    QUERIES[_name] = _query(_tables, _source, _key, _all)
    ORACLES[_name] = f"SELECT {_key}, {', '.join(f'{_DUCK[form].format(duck)} AS f_{name}' for name, form, _, duck in _all)} FROM {_duck}"
