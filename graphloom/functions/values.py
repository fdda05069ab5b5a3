"""``type::``, ``object::``, ``rand::``, ``meta::``, ``session::`` and ungrouped functions."""

GEOMETRY = {"collection": "GeometryCollection", "line": "LineString", "multiline": "MultiLineString", "multipoint": "MultiPoint", "multipolygon": "MultiPolygon", "point": "Point", "polygon": "Polygon"}
TYPES = {
    "array": "typeof({0}) LIKE 'array%'", "bool": "typeof({0}) = 'boolean'", "bytes": "typeof({0}) = 'binary'", "datetime": "typeof({0}) LIKE 'timestamp%'", "decimal": "typeof({0}) LIKE 'decimal%'",
    "duration": "typeof({0}) LIKE 'interval%'", "float": "typeof({0}) IN ('float', 'double')", "int": "typeof({0}) IN ('tinyint', 'smallint', 'int', 'bigint')",
    "none": "{0} IS NULL", "null": "{0} IS NULL", "number": "(typeof({0}) IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') OR typeof({0}) LIKE 'decimal%')",
    "object": "(typeof({0}) LIKE 'struct%' OR typeof({0}) LIKE 'map%')", "string": "typeof({0}) = 'string'",
    "uuid": "coalesce(regexp_replace(lower(string({0})), '[0-9a-f]', 'h') = 'hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh', false)",
}
#: The type that a geometry object names; null for any other value.
_SHAPE = "get_json_object(to_json(named_struct('v', {0})), '$.v.type')"
#: An object as JSON; its members as texts, JSON texts for nested ones, since an array has one type.
_JSON = "to_json({0}, map('ignoreNullFields', 'false'))"
_MEMBERS = f"from_json({_JSON}, 'map<string,string>')"
SESSION = {"db": "current_database()", "ns": "current_catalog()", "ac": "CAST(NULL AS STRING)", "id": "CAST(NULL AS STRING)", "ip": "CAST(NULL AS STRING)", "origin": "CAST(NULL AS STRING)", "rd": "CAST(NULL AS STRING)", "token": "CAST(NULL AS STRING)", "user": "current_user()"}
_V7 = "lpad(lower(hex(unix_millis({0|current_timestamp()}))), 12, '0')"
LINES = "\n".join(
    [
        *(f"type::is::{n}(any) -> bool = ({sql})" for n, sql in TYPES.items()),
        *(f"type::is::{n}(any) -> bool = coalesce({_SHAPE} = '{t}', false)" for n, t in GEOMETRY.items()),
        "type::is::geometry(any) -> bool = coalesce(" + _SHAPE + " IN (" + ", ".join(f"'{t}'" for t in GEOMETRY.values()) + "), false)",
        *(f"session::{n}() -> string = {sql}" for n, sql in SESSION.items()),
        f"object::entries(object) -> array<array<string>> = transform(map_entries({_MEMBERS}), _e -> array(_e.key, _e.value))",
        f"object::is_empty(object) -> bool = (size(json_object_keys({_JSON})) = 0)",
        f"object::keys(object) -> array<string> = json_object_keys({_JSON})",
        f"object::len(object) -> number = size(json_object_keys({_JSON}))",
        f"object::values(object) -> array<string> = map_values({_MEMBERS})",
        f"rand::uuid::v7(datetime?) -> uuid = concat_ws('-', substr({_V7}, 1, 8), substr({_V7}, 9, 4), concat('7', substr(replace(uuid(), '-', ''), 14, 3)), substr(uuid(), 20, 4), substr(replace(uuid(), '-', ''), 21, 12))",
        r"""
type::is::record(any, string?) -> bool = (string({0}) RLIKE concat('^', {1|'[A-Za-z_][A-Za-z0-9_]*'}, ':.+'))
type::array(any) -> array<any> = array({0})
type::bool(any) -> bool = cast({0} AS BOOLEAN)
type::bytes(any) -> bytes = cast({0} AS BINARY)
type::datetime(any) -> datetime = cast({0} AS TIMESTAMP)
type::decimal(any) -> number = cast({0} AS DECIMAL(38, 9))
type::duration(any) -> duration = make_dt_interval(7 * int(coalesce(nullif(regexp_extract({0}, '([0-9]+)w', 1), ''), '0')) + int(coalesce(nullif(regexp_extract({0}, '([0-9]+)d', 1), ''), '0')), int(coalesce(nullif(regexp_extract({0}, '([0-9]+)h', 1), ''), '0')), int(coalesce(nullif(regexp_extract({0}, '([0-9]+)m', 1), ''), '0')), int(coalesce(nullif(regexp_extract({0}, '([0-9]+)s', 1), ''), '0')))
type::field(any) -> any = {0}
type::fields(any) -> any = {0}
type::float(any) -> number = cast({0} AS DOUBLE)
type::int(any) -> number = cast({0} AS BIGINT)
type::number(any) -> number = cast({0} AS DOUBLE)
type::point(any, any?) -> point = named_struct('type', 'Point', 'coordinates', cast({0} AS array<double>))
type::range(any, any?) -> range = named_struct('beg', get({0}, 0), 'end', get({0}, 1), 'incl', false)
type::record(any, any?) -> record = named_struct('tb', substring_index(string({0}), ':', 1), 'id', substring_index(string({0}), ':', -1))
type::string(any) -> string = cast({0} AS STRING)
type::table(any) -> string = cast({0} AS STRING)
type::thing(any, any) -> record = named_struct('tb', string({0}), 'id', string({1}))
type::uuid(any) -> uuid = lower(string({0}))
object::from_entries(array) -> object = map_from_entries(transform({0}, _e -> struct(string(get(_e, 0)) AS key, get(_e, 1) AS value)))
rand() -> number = rand()
rand::bool() -> bool = (rand() < 0.5)
rand::enum(any*) -> any = get(array({*}), int(floor(rand() * size(array({*})))))
rand::float(number?, number?) -> number = ({0|0D} + rand() * ({1|1D} - {0|0D}))
rand::int(number, number) -> number = cast({0} + floor(rand() * ({1} - {0} + 1)) AS BIGINT)
rand::uuid(datetime?) -> uuid = uuid()
rand::uuid::v4(datetime?) -> uuid = uuid()
rand::ulid(datetime?) -> uuid = graphloom_ulid(unix_millis({0|current_timestamp()}))
session::*(any*) -> string = CAST(NULL AS STRING)
meta::id(any) -> string = substring_index({0}, ':', -1)
meta::tb(any) -> string = substring_index({0}, ':', 1)
sleep(any*) -> null = CAST(NULL AS VOID)
count(any*) -> int = CASE WHEN {0|true} IS NULL THEN 0L ELSE 1L END
http::head(any*) -> null = ! queries make no requests
http::get(any*) -> object = ! queries make no requests
http::put(any*) -> object = ! queries make no requests
http::post(any*) -> object = ! queries make no requests
http::patch(any*) -> object = ! queries make no requests
http::delete(any*) -> object = ! queries make no requests
not(any) -> bool = (NOT {0})
""",
    ]
)
