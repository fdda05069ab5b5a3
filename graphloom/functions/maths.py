"""``math::`` functions. Nulls do not count; quantiles interpolate linearly; spread measures are of samples."""

_A = "filter(cast({0} AS array<double>), _e -> _e IS NOT NULL)"


def mean(a: str = _A) -> str:
    return f"try_divide(aggregate({a}, 0D, (_p, _e) -> _p + _e), size({a}))"


def variance(a: str = _A) -> str:
    # the mean is bound once, by a transform of an array of it
    return f"get(transform(array({mean(a)}), _m -> try_divide(aggregate({a}, 0D, (_p, _e) -> _p + (_e - _m) * (_e - _m)), size({a}) - 1)), 0)"


def quantile(p: str, a: str = _A) -> str:
    at = f"((size(_q) - 1) * ({p}))"
    low = f"get(_q, int(floor({at})))"
    return f"get(transform(array(array_sort({a})), _q -> {low} + ({at} - floor({at})) * (get(_q, int(ceil({at}))) - {low})), 0)"


CONSTANTS = {
    "e": "e()", "pi": "pi()", "inf": "double('Infinity')", "neg_inf": "double('-Infinity')", "tau": "(2 * pi())",
    "ln_10": "ln(10D)", "ln_2": "ln(2D)", "log10_2": "log10(2D)", "log10_e": "log10(e())", "log2_10": "log2(10D)", "log2_e": "log2(e())",
    "frac_1_pi": "(1 / pi())", "frac_1_sqrt_2": "(1 / sqrt(2D))", "frac_2_pi": "(2 / pi())", "frac_2_sqrt_pi": "(2 / sqrt(pi()))",
    "frac_pi_2": "(pi() / 2)", "frac_pi_3": "(pi() / 3)", "frac_pi_4": "(pi() / 4)", "frac_pi_6": "(pi() / 6)", "frac_pi_8": "(pi() / 8)", "sqrt_2": "sqrt(2D)",
}
ONE = {
    "acot": "(pi() / 2 - atan({0}))", "cot": "cot({0})", "rad2deg": "degrees({0})", "deg2rad": "radians({0})", "round": "round({0})", "sign": "sign({0})",
    **{n: f"{n}({{0}})" for n in ("abs", "acos", "asin", "atan", "ceil", "cos", "floor", "ln", "log10", "log2", "sin", "sqrt", "tan")},
}
OF_ARRAY = {
    "mean": mean(), "median": quantile("0.5D"), "midhinge": f"(({quantile('0.25D')} + {quantile('0.75D')}) / 2)",
    "min": f"array_min({_A})", "max": f"array_max({_A})", "product": f"aggregate({_A}, 1D, (_p, _e) -> _p * _e)",
    "mode": f"get(transform(array({_A}), _a -> get(transform(array_sort(transform(array_distinct(_a), _e -> named_struct('k', -size(filter(_a, _f -> _f = _e)), 'e', -_e))), _t -> -_t.e), 0)), 0)",
    "stddev": f"sqrt({variance()})", "variance": variance(), "sum": f"aggregate({_A}, 0D, (_p, _e) -> _p + _e)",
    "spread": f"(array_max({_A}) - array_min({_A}))", "interquartile": f"({quantile('0.75D')} - {quantile('0.25D')})",
    "trimean": f"(({quantile('0.25D')} + 2 * {quantile('0.5D')} + {quantile('0.75D')}) / 4)",
}
#: The functions over arrays as aggregates of a group, by the column.
AGGREGATES = {
    "mean": "avg({0})", "median": "percentile({0}, 0.5D)", "midhinge": "((percentile({0}, 0.25D) + percentile({0}, 0.75D)) / 2)", "min": "min({0})", "max": "max({0})",
    "mode": "mode({0}, true)", "product": "CASE WHEN count_if({0} = 0) > 0 THEN 0D ELSE if(pmod(count_if({0} < 0), 2) = 1, -1D, 1D) * exp(sum(ln(abs(nullif({0}, 0))))) END", "stddev": "stddev_samp({0})", "variance": "var_samp({0})", "sum": "sum({0})", "spread": "(max({0}) - min({0}))",
    "percentile": "percentile({0}, {1|0.5D})", "interquartile": "(percentile({0}, 0.75D) - percentile({0}, 0.25D))",
    "trimean": "((percentile({0}, 0.25D) + 2 * percentile({0}, 0.5D) + percentile({0}, 0.75D)) / 4)",
    "nearestrank": "percentile_disc({1|0.5D}) WITHIN GROUP (ORDER BY {0})", "top": "slice(sort_array(collect_list({0}), false), 1, {1})", "bottom": "slice(sort_array(collect_list({0})), 1, {1})",
}
LINES = "\n".join(
    [
        *(f"math::{n}() -> number = {sql}" for n, sql in CONSTANTS.items()),
        *(f"math::{n}(number) -> number = {sql}" for n, sql in ONE.items()),
        *(f"math::{n}(array) -> number = {sql}" for n, sql in OF_ARRAY.items()),
        f"math::percentile(array, number?) -> number = {quantile('{1|0.5D}')}",
        f"math::nearestrank(array, number?) -> number = get(array_sort({_A}), int(greatest(ceil({{1|0.5D}} * size({_A})), 1) - 1))",
        "math::fixed(number, number) -> number = round({0}, cast({1} AS INT))",
        "math::clamp(number, number, number) -> number = least(greatest({0}, {1}), {2})",
        "math::log(number, number) -> number = log({1}, {0})",
        "math::lerp(number, number, number) -> number = ({0} + ({1} - {0}) * {2})",
        "math::lerpangle(number, number, number) -> number = ({0} + (pmod({1} - {0} + 540, 360) - 180) * {2})",
        "math::pow(number, number) -> number = pow({0}, {1})",
        "math::bottom(array, number) -> 0 = slice(array_sort({0}), 1, cast({1} AS INT))",
        "math::top(array, number) -> 0 = slice(sort_array({0}, false), 1, cast({1} AS INT))",
    ]
)
