"""``string::``, ``parse::``, ``crypto::``, ``encoding::`` and ``search::`` functions."""

LINES = r"""
string::concat(any*) -> string = concat({*})
string::contains(string, string) -> bool = contains({0}, {1})
string::ends_with(string, string) -> bool = endswith({0}, {1})
string::join(string, any*) -> string = concat_ws({*})
string::len(string) -> number = char_length({0})
string::lowercase(string) -> string = lower({0})
string::matches(string, string) -> bool = ({0} RLIKE {1})
string::repeat(string, number) -> string = repeat({0}, cast({1} AS INT))
string::replace(string, string, string) -> string = replace({0}, {1}, {2})
string::reverse(string) -> string = reverse({0})
string::slice(string, number, number?) -> string = substring({0}, if({1} < 0, cast({1} AS INT), cast({1} AS INT) + 1), cast({2|2147483647} AS INT))
string::slug(string) -> string = trim(BOTH '-' FROM regexp_replace(lower({0}), '[^a-z0-9]+', '-'))
string::split(string, string) -> array<string> = split({0}, concat('\\Q', {1}, '\\E'))
string::starts_with(string, string) -> bool = startswith({0}, {1})
string::trim(string) -> string = regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')
string::uppercase(string) -> string = upper({0})
string::words(string) -> array<string> = filter(split({0}, '\\s+'), _w -> _w <> '')
parse::email::host(string) -> string = split_part({0}, '@', -1)
parse::email::user(string) -> string = split_part({0}, '@', 1)
parse::url::domain(string) -> string = try_parse_url({0}, 'HOST')
parse::url::fragment(string) -> string = try_parse_url({0}, 'REF')
parse::url::host(string) -> string = try_parse_url({0}, 'HOST')
parse::url::path(string) -> string = try_parse_url({0}, 'PATH')
parse::url::scheme(string) -> string = try_parse_url({0}, 'PROTOCOL')
parse::url::query(string) -> string = try_parse_url({0}, 'QUERY')
parse::url::port(string) -> number = try_cast(regexp_extract({0}, '^[^:/]+://[^/:]+:([0-9]+)', 1) AS INT)
crypto::md5(string) -> string = md5({0})
crypto::sha1(string) -> string = sha1({0})
crypto::sha256(string) -> string = sha2({0}, 256)
crypto::sha512(string) -> string = sha2({0}, 512)
crypto::blake3(string) -> string = graphloom_blake3({0})
crypto::argon2::generate(string) -> string = ! needs a library that is not part of the engine
crypto::argon2::compare(string, string) -> bool = ! needs a library that is not part of the engine
crypto::bcrypt::generate(string) -> string = ! needs a library that is not part of the engine
crypto::bcrypt::compare(string, string) -> bool = ! needs a library that is not part of the engine
crypto::pbkdf2::generate(string) -> string = graphloom_pbkdf2({0})
crypto::pbkdf2::compare(string, string) -> bool = graphloom_pbkdf2_ok({0}, {1})
crypto::scrypt::generate(string) -> string = graphloom_scrypt({0})
crypto::scrypt::compare(string, string) -> bool = graphloom_scrypt_ok({0}, {1})
encoding::base64::encode(any) -> string = base64(cast({0} AS BINARY))
encoding::base64::decode(string) -> bytes = unbase64({0})
search::analyze(string, string) -> array<string> = filter(split(lower({1}), '[^\\p{L}\\p{N}]+'), _t -> _t <> '')
search::score(number) -> number = ! is made by the search operator, bm25()
search::highlight(string, string, number, any?) -> string = ! needs the terms of a MATCHES predicate
search::offsets(number, any?) -> object = ! needs the terms of a MATCHES predicate
"""
