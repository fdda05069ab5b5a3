"""``vector::`` functions; vectors of different sizes are an error when the query runs."""

_A, _B = "cast({0} AS array<double>)", "cast({1} AS array<double>)"


def checked(sql: str) -> str:
    return f"if(size({{0}}) = size({{1}}), {sql}, raise_error('vectors differ in size'))"


def zipped(body: str, a: str = _A, b: str = _B) -> str:
    return f"zip_with({a}, {b}, (_p, _q) -> {body})"


def total(sql: str) -> str:
    return f"aggregate({sql}, 0D, (_s, _e) -> _s + _e)"


def dot(a: str = _A, b: str = _B) -> str:
    return total(zipped("_p * _q", a, b))


def size_of(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def centred(a: str) -> str:
    return f"get(transform(array({total(a)} / size({a})), _m -> transform({a}, _x -> _x - _m)), 0)"


_COSINE = f"({dot()} / ({size_of(_A)} * {size_of(_B)}))"
PAIRS = {
    "add": ("array<number>", zipped("_p + _q")), "subtract": ("array<number>", zipped("_p - _q")), "multiply": ("array<number>", zipped("_p * _q")), "divide": ("array<number>", zipped("try_divide(_p, _q)")),
    "cross": ("array<number>", "array(get({0}, 1) * get({1}, 2) - get({0}, 2) * get({1}, 1), get({0}, 2) * get({1}, 0) - get({0}, 0) * get({1}, 2), get({0}, 0) * get({1}, 1) - get({0}, 1) * get({1}, 0))"),
    "project": ("array<number>", f"get(transform(array({dot()} / {dot(_B, _B)}), _c -> transform({_B}, _x -> _x * _c)), 0)"),
    "angle": ("number", f"acos(least(1D, greatest(-1D, {_COSINE})))"), "dot": ("number", dot()),
    "distance::chebyshev": ("number", f"array_max({zipped('abs(_p - _q)')})"), "distance::euclidean": ("number", f"sqrt({total(zipped('(_p - _q) * (_p - _q)'))})"),
    "distance::hamming": ("number", f"size(filter({zipped('_p <> _q')}, _e -> _e))"), "distance::manhattan": ("number", total(zipped("abs(_p - _q)"))),
    "similarity::cosine": ("number", _COSINE), "similarity::pearson": ("number", f"({dot(centred(_A), centred(_B))} / ({size_of(centred(_A))} * {size_of(centred(_B))}))"),
}
LINES = "\n".join(
    [
        *(f"vector::{n}(array, array) -> {kind} = {checked(sql)}" for n, (kind, sql) in PAIRS.items()),
        "vector::similarity::jaccard(array, array) -> number = (size(array_intersect({0}, {1})) / size(array_union({0}, {1})))",
        f"vector::normalize(array) -> array<number> = get(transform(array({size_of(_A)}), _m -> transform({_A}, _x -> try_divide(_x, _m))), 0)",
        f"vector::scale(array, number) -> array<number> = transform({_A}, _x -> _x * {{1}})",
        f"vector::magnitude(array) -> number = {size_of(_A)}",
        "vector::distance::minkowski(array, array, number) -> number = " + checked(f"pow({total(zipped('pow(abs(_p - _q), {2})'))}, 1D / {{2}})"),
        "vector::distance::knn() -> number = __knn_dist",
    ]
)
