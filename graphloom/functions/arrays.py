"""``array::`` functions. Indexes count from 0, negative ones from the end, as in the language; Spark's from 1."""

LINES = """
array::all(array, any?) -> bool = forall({0}, {1|_e -> cast(_e AS BOOLEAN)})
array::any(array, any?) -> bool = exists({0}, {1|_e -> cast(_e AS BOOLEAN)})
array::is_empty(array) -> bool = (size({0}) = 0)
array::matches(array, any) -> bool = forall({0}, _e -> _e = {1})
array::add(array, any) -> 0 = if(array_contains({0}, {1}), {0}, array_append({0}, {1}))
array::append(array, any) -> 0 = array_append({0}, {1})
array::combine(array, array) -> 0 = flatten(transform({0}, _l -> transform({1}, _r -> array(_l, _r))))
array::fill(array, any, number?, number?) -> 0 = transform({0}, (_e, _k) -> if(_k >= {2|0} AND _k < {3|2147483647}, {1}, _e))
array::insert(array, any, number) -> 0 = if(cast({2} AS INT) BETWEEN 0 AND size({0}), array_insert({0}, cast({2} AS INT) + 1, {1}), {0})
array::prepend(array, any) -> 0 = array_prepend({0}, {1})
array::push(array, any) -> 0 = array_append({0}, {1})
array::remove(array, number) -> 0 = filter({0}, (_e, _k) -> _k <> if({1} < 0, size({0}) + {1}, {1}))
array::reverse(array) -> 0 = reverse({0})
array::shuffle(array) -> 0 = shuffle({0})
array::sort(array, any?) -> 0 = sort_array({0}, {1|true})
array::sort::asc(array) -> 0 = array_sort({0})
array::sort::desc(array) -> 0 = sort_array({0}, false)
array::swap(array, number, number) -> 0 = transform({0}, (_e, _k) -> CASE _k WHEN {1} THEN get({0}, cast({2} AS INT)) WHEN {2} THEN get({0}, cast({1} AS INT)) ELSE _e END)
array::at(array, number) -> 0[] = if({1} >= 0, get({0}, cast({1} AS INT)), try_element_at({0}, cast({1} AS INT)))
array::find(array, any) -> 0[] = get(filter({0}, {1}), 0)
array::first(array) -> 0[] = get({0}, 0)
array::last(array) -> 0[] = try_element_at({0}, -1)
array::pop(array) -> 0[] = try_element_at({0}, -1)
array::flatten(array) -> 0[] = flatten({0})
array::range(number, number) -> array<number> = if({1} <= 0, cast(array() AS array<int>), sequence(cast({0} AS INT), cast({0} + greatest({1}, 1) - 1 AS INT)))
array::join(array, string) -> string = array_join(transform({0}, _e -> string(_e)), {1})
array::len(array) -> number = size({0})
array::distinct(array) -> 0 = array_distinct({0})
array::filter(array, any) -> 0 = filter({0}, {1})
array::group(array) -> 0 = array_distinct(flatten({0}))
array::slice(array, number, number?) -> 0 = slice({0}, if({1} < 0, cast({1} AS INT), cast({1} AS INT) + 1), cast({2|2147483647} AS INT))
array::windows(array, number) -> 0 = if(size({0}) < {1}, cast(array() AS array<array<string>>), transform(sequence(1, greatest(size({0}) - cast({1} AS INT) + 1, 1)), _k -> slice({0}, _k, cast({1} AS INT))))
array::union(array, array) -> 0 = array_union({0}, {1})
array::intersect(array, array) -> 0 = array_intersect({0}, {1})
array::complement(array, array) -> 0 = filter({0}, _e -> NOT array_contains({1}, _e))
array::max(array) -> 0[] = array_max({0})
array::min(array) -> 0[] = array_min({0})
array::transpose(array) -> 0 = {0}
"""
LINES = "\n".join(x for x in LINES.splitlines() if "transpose" not in x)
