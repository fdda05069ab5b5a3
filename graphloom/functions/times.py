"""``time::`` and ``duration::`` functions, in UTC and to the microsecond."""


def us(dur: str) -> str:
    return f"unix_micros(timestamp_micros(0) + {dur})"


UNITS = {"days": 86_400_000_000, "hours": 3_600_000_000, "micros": 1, "millis": 1_000, "mins": 60_000_000, "secs": 1_000_000, "weeks": 604_800_000_000, "years": 31_536_000_000_000}
PARTS = {
    "day": "dayofmonth({0})", "hour": "hour({0})", "micros": "unix_micros({0})", "millis": "unix_millis({0})", "minute": "minute({0})", "month": "month({0})",
    "nano": "unix_micros({0}) * 1000", "second": "second({0})", "unix": "unix_seconds({0})", "wday": "(weekday({0}) + 1)", "week": "weekofyear({0})",
    "yday": "dayofyear({0})", "year": "year({0})",
}
_TS = "cast({0|current_timestamp()} AS TIMESTAMP)"
_T, _D = "cast({0} AS TIMESTAMP)", us("{1}")
LINES = "\n".join(
    [
        *(f"time::{n}(datetime?) -> number = {sql.replace('{0}', _TS)}" for n, sql in PARTS.items()),
        *(f"duration::{n}(duration) -> number = floor({us('{0}')} / {size})" for n, size in UNITS.items()),
        f"duration::nanos(duration) -> number = {us('{0}')} * 1000",
        "duration::from::days(number) -> duration = make_dt_interval(cast({0} AS INT))",
        "duration::from::hours(number) -> duration = make_dt_interval(0, cast({0} AS INT))",
        "duration::from::micros(number) -> duration = make_dt_interval(0, 0, 0, cast({0} AS DECIMAL(20, 0)) / 1000000)",
        "duration::from::millis(number) -> duration = make_dt_interval(0, 0, 0, cast({0} AS DECIMAL(20, 0)) / 1000)",
        "duration::from::mins(number) -> duration = make_dt_interval(0, 0, cast({0} AS INT))",
        "duration::from::nanos(number) -> duration = make_dt_interval(0, 0, 0, cast(floor({0} / 1000) AS DECIMAL(20, 0)) / 1000000)",
        "duration::from::secs(number) -> duration = make_dt_interval(0, 0, 0, {0})",
        "duration::from::weeks(number) -> duration = make_dt_interval(cast(7 * {0} AS INT))",
        f"time::ceil(datetime, duration) -> datetime = timestamp_micros(unix_micros({_T}) + pmod(-unix_micros({_T}), {_D}))",
        f"time::floor(datetime, duration) -> datetime = timestamp_micros(unix_micros({_T}) - pmod(unix_micros({_T}), {_D}))",
        f"time::round(datetime, duration) -> datetime = timestamp_micros((unix_micros({_T}) + {_D} div 2) - pmod(unix_micros({_T}) + {_D} div 2, {_D}))",
        f"time::format(datetime, string) -> string = date_format({_T}, {{1}})",
        f"time::group(datetime, string) -> datetime = date_trunc({{1}}, {_T})",
        "time::max(array) -> datetime = array_max({0})",
        "time::min(array) -> datetime = array_min({0})",
        "time::now() -> datetime = current_timestamp()",
        "time::timezone() -> string = current_timezone()",
        f"time::is::leap_year(datetime) -> bool = (dayofmonth(last_day(make_date(year({_T}), 2, 1))) = 29)",
        "time::from::micros(number) -> datetime = timestamp_micros(cast({0} AS BIGINT))",
        "time::from::millis(number) -> datetime = timestamp_millis(cast({0} AS BIGINT))",
        "time::from::nanos(number) -> datetime = timestamp_micros(cast({0} AS BIGINT) div 1000)",
        "time::from::secs(number) -> datetime = timestamp_seconds({0})",
        "time::from::unix(number) -> datetime = timestamp_seconds({0})",
        "time::from::ulid(string) -> datetime = timestamp_millis(aggregate(transform(sequence(1, 10), _k -> bigint(instr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr({0}, _k, 1)) - 1)), 0L, (_p, _e) -> _p * 32 + _e))",
        "time::from::uuid(uuid) -> datetime = timestamp_millis(bigint(conv(substr(replace({0}, '-', ''), 1, 12), 16, 10)))",
    ]
)
