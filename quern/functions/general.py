"""Macros for text, numbers, dates, JSON, URLs, encodings, vectors and the session.

One a line: name(parameters) type = expression.  Names with q_ differ from a built-in of the
same name; the dialect calls them under the plain name.
"""

MACROS = r"""
-- text
q_length(s STRING) INT = octet_length(s)
strlen(s STRING) INT = octet_length(s)
q_substr(s STRING, a INT, n INT) STRING = substring(s, greatest(a, 1), greatest(0, a + n - greatest(a, 1)))
q_substr2(s STRING, a INT) STRING = substring(s, greatest(a, 1))
q_trim(s STRING) STRING = trim(BOTH ' \t\n\r' FROM s)
q_ltrim(s STRING) STRING = trim(LEADING ' \t\n\r' FROM s)
q_rtrim(s STRING) STRING = trim(TRAILING ' \t\n\r' FROM s)
starts_with(s STRING, p STRING) BOOLEAN = startswith(s, p)
ends_with(s STRING, p STRING) BOOLEAN = endswith(s, p)
q_split_part(s STRING, d STRING, i INT) STRING = CASE WHEN s IS NULL OR d IS NULL OR i IS NULL THEN NULL WHEN i < 1 THEN '' WHEN d = '' THEN if(i = 1, s, '') ELSE coalesce(split_part(s, d, i), '') END
strpos(s STRING, p STRING) INT = instr(s, p)
q_regexp_extract(s STRING, p STRING, g INT) STRING = CASE WHEN s RLIKE p THEN regexp_extract(s, p, g) END
q_regexp_replace(s STRING, p STRING, r STRING) STRING = regexp_replace(s, p, regexp_replace(replace(r, '$', '\\$'), '\\\\([0-9])', '\\$$1'))
regexp_split(s STRING, p STRING) STRING = to_json(split(s, p))
q_split(s STRING, d STRING) STRING = to_json(split(s, concat('\\Q', d, '\\E')))
q_regexp_extract_all(s STRING, p STRING) STRING = to_json(regexp_extract_all(s, p, 0))
codepoint(s STRING) INT = nullif(ascii(s), 0)
levenshtein_distance(a STRING, b STRING) INT = levenshtein(a, b)
hamming_distance(a STRING, b STRING) INT = CASE WHEN char_length(a) = char_length(b) THEN if(a = '', 0, size(filter(sequence(1, greatest(char_length(a), 1)), k -> substr(a, k, 1) <> substr(b, k, 1)))) END
to_utf8(s STRING) BINARY = encode(s, 'UTF-8')
from_utf8(b BINARY) STRING = CASE WHEN is_valid_utf8(CAST(b AS STRING)) THEN CAST(b AS STRING) END
quote_ident(s STRING) STRING = CASE WHEN s RLIKE '^[a-z_][a-z0-9_]*$' THEN s ELSE concat('"', replace(s, '"', '""'), '"') END
quote_literal(s STRING) STRING = concat('\'', replace(s, '\'', '\'\''), '\'')
quote_nullable(s STRING) STRING = coalesce(concat('\'', replace(s, '\'', '\'\''), '\''), 'NULL')
-- numbers
round_half_even(x DOUBLE, d INT) DOUBLE = if(d = 0, bround(x), bround(x * pow(10, d)) / pow(10, d))
q_sqrt(x DOUBLE) DOUBLE = CASE WHEN x >= 0 THEN sqrt(x) END
q_log2(b DOUBLE, x DOUBLE) DOUBLE = CASE WHEN b > 0 AND b <> 1 AND x > 0 THEN log(b, x) END
q_log(x DOUBLE) DOUBLE = CASE WHEN x > 0 THEN log10(x) END
q_asin(x DOUBLE) DOUBLE = CASE WHEN x BETWEEN -1 AND 1 THEN asin(x) END
q_acos(x DOUBLE) DOUBLE = CASE WHEN x BETWEEN -1 AND 1 THEN acos(x) END
truncate(x DOUBLE, d INT) DOUBLE = if(x >= 0, floor(x * pow(10, d)), ceil(x * pow(10, d))) / pow(10, d)
q_trunc(x DOUBLE) DOUBLE = if(x >= 0, floor(x), ceil(x))
infinity() DOUBLE = double('Infinity')
q_nan() DOUBLE = double('NaN')
is_nan(x DOUBLE) BOOLEAN = if(x IS NULL, NULL, isnan(x))
is_finite(x DOUBLE) BOOLEAN = x NOT IN (double('Infinity'), double('-Infinity')) AND NOT isnan(x)
is_infinite(x DOUBLE) BOOLEAN = x IN (double('Infinity'), double('-Infinity'))
from_base(s STRING, b INT) BIGINT = CASE WHEN s RLIKE '^-?[0-9a-zA-Z]+$' AND upper(conv(upper(ltrim('0', replace(s, '-', ''))), b, b)) = upper(ltrim('0', replace(s, '-', ''))) THEN if(s LIKE '-%', -1, 1) * try_cast(conv(replace(s, '-', ''), b, 10) AS BIGINT) END
to_base(i BIGINT, b INT) STRING = concat(if(i < 0, '-', ''), lower(conv(CAST(abs(i) AS STRING), 10, b)))
bitwise_and(a BIGINT, b BIGINT) BIGINT = a & b
bitwise_or(a BIGINT, b BIGINT) BIGINT = a | b
bitwise_xor(a BIGINT, b BIGINT) BIGINT = a ^ b
bitwise_not(a BIGINT) BIGINT = ~a
bitwise_left_shift(a BIGINT, n INT) BIGINT = CASE WHEN n BETWEEN 0 AND 63 THEN shiftleft(a, n) END
bitwise_right_shift(a BIGINT, n INT) BIGINT = CASE WHEN n BETWEEN 0 AND 63 THEN shiftrightunsigned(a, n) END
bitwise_arithmetic_shift_right(a BIGINT, n INT) BIGINT = CASE WHEN n BETWEEN 0 AND 63 THEN shiftright(a, n) END
cast_int(x DOUBLE) BIGINT = try_cast(round(x) AS BIGINT)
cast_float(s STRING) DOUBLE = coalesce(try_cast(s AS DOUBLE), if(s IS NULL, NULL, 0))
cast_string(s STRING) STRING = s
-- dates
day_of_week(t TIMESTAMP) INT = dayofweek(t) - 1
day_of_year(t TIMESTAMP) INT = dayofyear(t)
week(t TIMESTAMP) INT = weekofyear(t)
epoch(t TIMESTAMP) BIGINT = unix_timestamp(t)
q_date_diff(a TIMESTAMP, b TIMESTAMP) BIGINT = CAST(floor((unix_millis(a) - unix_millis(b)) / 86400000) AS BIGINT)
q_to_date(s STRING) DATE = try_to_date(s)
last_day_of_month(t TIMESTAMP) DATE = last_day(t)
q_java_format(f STRING) STRING = replace(replace(replace(replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%y', 'yy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%i', 'mm'), '%s', 'ss'), '%M', 'MMMM'), '%b', 'MMM')
q_date_format(t TIMESTAMP, f STRING) STRING = date_format(t, q_java_format(f))
date_parse(s STRING, f STRING) TIMESTAMP = try_to_timestamp(s, q_java_format(f))
q_from_unixtime(i BIGINT) TIMESTAMP = timestamp_seconds(i)
to_unixtime(t TIMESTAMP) BIGINT = unix_timestamp(t)
q_zone(z STRING) STRING = CASE WHEN try_to_timestamp(concat('2000-01-01 00:00:00 ', z), 'yyyy-MM-dd HH:mm:ss VV') IS NOT NULL THEN z END
at_timezone(t TIMESTAMP, z STRING) TIMESTAMP = from_utc_timestamp(t, q_zone(z))
q_timezone(z STRING, t TIMESTAMP) TIMESTAMP = to_utc_timestamp(t, q_zone(z))
from_iso8601_timestamp(s STRING) BIGINT = unix_millis(try_to_timestamp(s))
from_iso8601_date(s STRING) DATE = try_to_date(s, 'yyyy-MM-dd')
to_iso8601(i BIGINT) STRING = date_format(timestamp_millis(i), "yyyy-MM-dd'T'HH:mm:ssXXX")
to_milliseconds(s STRING) BIGINT = coalesce(try_cast(s AS BIGINT), unix_millis(try_to_timestamp(s)))
timezone_hour(t TIMESTAMP) BIGINT = if(t IS NULL, NULL, 0)
timezone_minute(t TIMESTAMP) BIGINT = if(t IS NULL, NULL, 0)
q_unit(n BIGINT, u STRING) STRING = CASE WHEN n = 1 THEN concat('1 ', u) WHEN n > 1 THEN concat(n, ' ', u, 's') END
human_readable_seconds(i BIGINT) STRING = CASE WHEN i = 0 THEN '0 seconds' ELSE concat(if(i < 0, '-', ''), concat_ws(', ', q_unit(abs(i) div 86400, 'day'), q_unit(abs(i) div 3600 % 24, 'hour'), q_unit(abs(i) div 60 % 60, 'minute'), q_unit(abs(i) % 60, 'second'))) END
-- JSON
q_json_path(p STRING) STRING = if(p LIKE '$%', p, concat('$.', p))
json_extract(s STRING, p STRING) STRING = get_json_object(s, q_json_path(p))
json_extract_scalar(s STRING, p STRING) STRING = CASE WHEN NOT coalesce(get_json_object(s, q_json_path(p)) RLIKE '^[\\[{]', false) THEN get_json_object(s, q_json_path(p)) END
json_valid(s STRING) BOOLEAN = if(s IS NULL, NULL, try_parse_json(s) IS NOT NULL)
-- URLs and domains
url_extract_host(s STRING) STRING = try_parse_url(s, 'HOST')
url_extract_port(s STRING) INT = try_cast(nullif(regexp_extract(try_parse_url(s, 'AUTHORITY'), ':([0-9]+)$', 1), '') AS INT)
url_extract_path(s STRING) STRING = try_parse_url(s, 'PATH')
url_extract_protocol(s STRING) STRING = try_parse_url(s, 'PROTOCOL')
url_extract_query(s STRING) STRING = coalesce(try_parse_url(s, 'QUERY'), if(s IS NULL, NULL, ''))
url_extract_parameter(s STRING, k STRING) STRING = coalesce(try_parse_url(s, 'QUERY', k), if(s IS NULL, NULL, ''))
q_url_decode(s STRING) STRING = try_url_decode(s)
domain_depth(s STRING) INT = size(split(rtrim('.', lower(s)), '\\.'))
-- encodings, hashes, sizes
to_hex(i BIGINT) STRING = lower(hex(i))
from_hex(s STRING) BIGINT = try_cast(conv(s, 16, 10) AS BIGINT)
to_base64(s STRING) STRING = base64(encode(s, 'UTF-8'))
from_base64(s STRING) STRING = CASE WHEN is_valid_utf8(CAST(try_to_binary(s, 'base64') AS STRING)) THEN CAST(try_to_binary(s, 'base64') AS STRING) END
sha256(s STRING) STRING = sha2(s, 256)
sha512(s STRING) STRING = sha2(s, 512)
uuid_version(s STRING) INT = CASE WHEN char_length(replace(s, '-', '')) = 32 THEN try_cast(conv(substr(replace(s, '-', ''), 13, 1), 16, 10) AS INT) END
uuid_to_string(s STRING) STRING = lower(regexp_replace(replace(s, '-', ''), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'))
q_scaled(n DOUBLE, base DOUBLE) INT = if(abs(n) < base, 0, CAST(least(4, floor(ln(abs(n)) / ln(base) + 1e-12)) AS INT))
format_bytes(n DOUBLE) STRING = if(abs(n) < 1024, concat(CAST(n AS BIGINT), ' B'), concat(round(n / pow(1024, q_scaled(n, 1024)), 2), ' ', element_at(array('KiB', 'MiB', 'GiB', 'TiB'), greatest(1, q_scaled(n, 1024)))))
format_rate(n DOUBLE) STRING = if(abs(n) * 8 < 1000, concat(CAST(n * 8 AS BIGINT), ' bps'), concat(round(n * 8 / pow(1000, q_scaled(n * 8, 1000)), 2), ' ', element_at(array('Kbps', 'Mbps', 'Gbps', 'Tbps'), greatest(1, q_scaled(n * 8, 1000)))))
q_power_of(u STRING) INT = CASE left(lower(u), 1) WHEN 'k' THEN 1 WHEN 'm' THEN 2 WHEN 'g' THEN 3 WHEN 't' THEN 4 WHEN 'p' THEN 5 ELSE 0 END
parse_bytes(s STRING) BIGINT = CAST(try_cast(nullif(regexp_extract(trim(s), '^([0-9.]+) *([kKmMgGtTpP]?i?)[bB]?$', 1), '') AS DOUBLE) * pow(if(s LIKE '%i%', 1024, 1000), q_power_of(regexp_extract(trim(s), '^([0-9.]+) *([kKmMgGtTpP]?i?)[bB]?$', 2))) AS BIGINT)
parse_rate(s STRING) BIGINT = CAST(try_cast(nullif(regexp_extract(trim(s), '^([0-9.]+) *([kKmMgGtT]?)(bps|B/s)$', 1), '') AS DOUBLE) * pow(1000, q_power_of(regexp_extract(trim(s), '^([0-9.]+) *([kKmMgGtT]?)(bps|B/s)$', 2))) / if(s LIKE '%bps', 8, 1) AS BIGINT)
-- arrays and vectors
array_length(a ARRAY<STRING>) INT = size(a)
array_to_string(a ARRAY<STRING>, d STRING) STRING = array_join(a, d)
q_vec_ok(a ARRAY<FLOAT>, b ARRAY<FLOAT>) BOOLEAN = size(a) = size(b) AND size(a) > 0
dot_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = CASE WHEN q_vec_ok(a, b) THEN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (p, q) -> p + q) END
l2_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = CASE WHEN q_vec_ok(a, b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> pow(double(x) - double(y), 2)), 0D, (p, q) -> p + q)) END
vector_norm(a ARRAY<FLOAT>) DOUBLE = sqrt(aggregate(a, 0D, (p, x) -> p + double(x) * double(x)))
cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = CASE WHEN q_vec_ok(a, b) THEN coalesce(try_divide(dot_product(a, b), vector_norm(a) * vector_norm(b)), 0D) END
vector_dims(a ARRAY<FLOAT>) INT = size(a)
embed_model() STRING = 'hash'
embed_dim() INT = 8
-- session
current_role() STRING = current_user()
current_schemas(implicit BOOLEAN) STRING = '{public}'
pg_postmaster_start_time() TIMESTAMP = current_timestamp()
current_setting(s STRING) STRING = CASE lower(s) WHEN 'server_encoding' THEN 'UTF8' WHEN 'client_encoding' THEN 'UTF8' WHEN 'timezone' THEN 'UTC' WHEN 'datestyle' THEN 'ISO, MDY' WHEN 'standard_conforming_strings' THEN 'on' WHEN 'integer_datetimes' THEN 'on' END
set_config(s STRING, v STRING, l BOOLEAN) STRING = v
pg_backend_pid() INT = 1
pg_client_encoding() STRING = 'UTF8'
pg_encoding_to_char(i INT) STRING = CASE WHEN i = 6 THEN 'UTF8' ELSE '' END
pg_is_in_recovery() BOOLEAN = false
pg_my_temp_schema() BIGINT = 0L
pg_conf_load_time() STRING = CAST(current_timestamp() AS STRING)
inet_server_addr() STRING = CAST(NULL AS STRING)
inet_client_addr() STRING = CAST(NULL AS STRING)
current_query() STRING = CAST(NULL AS STRING)
txid_current() BIGINT = 1L
pg_current_xact_id() BIGINT = 1L
has_table_privilege(o STRING, p STRING) BOOLEAN = true
has_schema_privilege(o STRING, p STRING) BOOLEAN = true
has_database_privilege(o STRING, p STRING) BOOLEAN = true
has_column_privilege(o STRING, c STRING, p STRING) BOOLEAN = true
has_function_privilege(o STRING, p STRING) BOOLEAN = true
has_sequence_privilege(o STRING, p STRING) BOOLEAN = true
has_tablespace_privilege(o STRING, p STRING) BOOLEAN = true
pg_has_role(o STRING, p STRING) BOOLEAN = true
pg_table_is_visible(o BIGINT) BOOLEAN = true
pg_type_is_visible(o BIGINT) BOOLEAN = true
pg_function_is_visible(o BIGINT) BOOLEAN = true
pg_opclass_is_visible(o BIGINT) BOOLEAN = true
pg_operator_is_visible(o BIGINT) BOOLEAN = true
pg_collation_is_visible(o BIGINT) BOOLEAN = true
obj_description(o BIGINT, c STRING) STRING = CAST(NULL AS STRING)
col_description(o BIGINT, c INT) STRING = CAST(NULL AS STRING)
shobj_description(o BIGINT, c STRING) STRING = CAST(NULL AS STRING)
"""
