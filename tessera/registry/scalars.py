"""One query to a scalar function or operator: (table and key, our expression, the oracle's)."""

from __future__ import annotations

from tessera.registry import in_sql

_P, _C, _E, _N, _L, _D = "part p_partkey", "customer c_custkey", "events event_id", "nation n_nationkey", "orders o_orderkey", "documents doc_id"
_WORDS = "string_to_array(p_name, ' ')"
_DWORDS = "string_split(p_name, ' ')"
_ARR = "[p_size, p_size % 7, NULL, 3, p_size % 3]"
_BRR = "[3, p_size % 5, 40]"
_SAY = "array_to_string({}, ',', 'N')"
_DSAY = "list_aggregate(list_transform({}, lambda e: coalesce(CAST(e AS VARCHAR), 'N')), 'string_agg', ',')"


def _list(ours: str, theirs: str) -> tuple[str, str]:
    """Lists are compared as text; an empty list is an empty text in both."""
    return _SAY.format(ours), f"coalesce({_DSAY.format(theirs)}, '')"


FUNCTIONS: dict[str, tuple[str, str, str | None]] = {
    # strings
    "ascii": (_P, "ascii(p_name)", None),
    "bit_length": (_P, "CAST(bit_length(p_name) AS BIGINT)", None),
    "btrim": (_P, "btrim(p_name, 'aeg')", "trim(p_name, 'aeg')"),
    "chr": (_P, "chr(128512 + p_size)", None),
    "concat": (_P, "concat(p_name, nullif(p_brand, 'Brand#11'), '-', p_size)", None),
    "concat_ws": (_P, "concat_ws('|', p_name, nullif(p_size, 7), p_type)", None),
    "contains": (_P, "contains(p_name, 'ar')", None),
    "ends_with": (_P, "ends_with(p_type, 'L')", None),
    "levenshtein": (_P, "CAST(levenshtein(p_name, p_type) AS BIGINT)", None),
    "lower": (_P, "lower(p_type)", None),
    "upper": (_P, "upper(p_name)", None),
    "ltrim": (_P, "ltrim(p_brand, 'Bra')", None),
    "rtrim": (_P, "rtrim(p_brand, '0123')", None),
    "trim": (_P, "trim(concat('  ', p_name, ' '))", None),
    "octet_length": (_D, "CAST(octet_length(text) AS BIGINT)", "CAST(strlen(text) AS BIGINT)"),
    "repeat": (_P, "repeat(p_brand, p_size % 4)", None),
    "replace": (_P, "replace(p_name, 'a', '--')", None),
    "split_part": (_P, "split_part(p_name, ' ', -1)", None),
    "starts_with": (_P, "starts_with(p_type, 'S')", None),
    "to_hex": (_P, "to_hex(p_partkey * 977)", "lower(to_hex(p_partkey * 977))"),
    "character_length": (_D, "CAST(character_length(text) AS BIGINT)", "length(text)"),
    "find_in_set": (_P, "CAST(find_in_set(CAST(p_size AS VARCHAR), '3,5,8,13,21,34') AS BIGINT)", "CAST(coalesce(list_position(['3','5','8','13','21','34'], CAST(p_size AS VARCHAR)), 0) AS BIGINT)"),
    "initcap": (_P, "initcap(replace(p_name, ' ', '-'))", "list_aggregate(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '-')"),
    "left": (_P, "left(p_name, (p_size % 7) - 3)", "CASE WHEN p_size % 7 - 3 < 0 THEN p_name[1:greatest(length(p_name) + (p_size % 7 - 3), 0)] ELSE left(p_name, p_size % 7 - 3) END"),
    "right": (_P, "right(p_name, (p_size % 7) - 3)", "CASE WHEN p_size % 7 - 3 < 0 THEN p_name[4 - p_size % 7 : ] ELSE right(p_name, p_size % 7 - 3) END"),
    "lpad": (_P, "lpad(p_brand, 12, '*-')", None),
    "rpad": (_P, "rpad(p_brand, 12, '*-')", None),
    "reverse": (_P, "reverse(p_name)", None),
    "strpos": (_P, "CAST(strpos(p_name, 'e') AS BIGINT)", None),
    "position_in": (_P, "CAST(position('e' IN p_name) AS BIGINT)", None),
    "substr": (_P, "substr(p_name, (p_size % 5) - 2, 4)", "p_name[greatest(p_size % 5 - 2, 1) : p_size % 5 - 2 + 3]"),
    "substring_from": (_P, "substring(p_name FROM 2 FOR 3)", None),
    "substr_index": (_P, "substr_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
    "translate": (_P, "translate(p_name, 'aeiou', '12')", None),
    "overlay": (_P, "overlay(p_name PLACING 'XX' FROM 2 FOR 3)", "p_name[1:1] || 'XX' || p_name[5:]"),
    "string_concat_operator": (_P, "p_name || '/' || nullif(p_brand, 'Brand#11')", None),
    # regular expressions
    "regexp_count": (_P, "CAST(regexp_count(p_name, '[ae]') AS BIGINT)", "CAST(length(regexp_replace(p_name, '[^ae]', '', 'g')) AS BIGINT)"),
    "regexp_instr": (_P, "CAST(regexp_instr(p_name, 'e') AS BIGINT)", "CAST(strpos(p_name, 'e') AS BIGINT)"),
    "regexp_instr_nth": (_P, "CAST(regexp_instr(p_name, 'e', 1, 2) AS BIGINT)", "CASE WHEN strpos(p_name, 'e') = 0 OR strpos(p_name[strpos(p_name, 'e') + 1 :], 'e') = 0 THEN 0 ELSE strpos(p_name, 'e') + strpos(p_name[strpos(p_name, 'e') + 1 :], 'e') END"),
    "regexp_like": (_P, "regexp_like(p_type, 'st[a-z]+', 'i')", "regexp_matches(p_type, 'st[a-z]+', 'i')"),
    "regexp_match": (_P, *_list("regexp_match(p_name, '([a-z])([a-z]) ')", "CASE WHEN regexp_matches(p_name, '([a-z])([a-z]) ') THEN [regexp_extract(p_name, '([a-z])([a-z]) ', 1), regexp_extract(p_name, '([a-z])([a-z]) ', 2)] END")),
    "regexp_replace": (_P, r"regexp_replace(p_name, '([aeiou])', '<\1>')", None),
    "regexp_replace_all": (_P, r"regexp_replace(p_name, '([AEIOU])', '<\1>', 'gi')", None),
    "regex_operators": (_P, "concat(p_name ~ '^[a-m]', p_name ~* '^[A-M]', p_name !~ 'e', p_name !~* 'E')", "concat(regexp_matches(p_name, '^[a-m]'), regexp_matches(p_name, '^[A-M]', 'i'), NOT regexp_matches(p_name, 'e'), NOT regexp_matches(p_name, 'E', 'i'))"),
    "like_operators": (_P, "p_name LIKE '%a_e%' OR p_name ILIKE 'A%' OR p_type NOT LIKE '%R%'", None),
    "like_tildes": (_P, "(p_name ~~ '%a%') AND (p_name !~~ '%b%')", None),
    "similar_to": (_P, "p_brand SIMILAR TO 'Brand#(1|2).*'", "regexp_matches(p_brand, 'Brand#(1|2).*')"),
    # numbers
    "abs": (_C, "abs(c_acctbal)", None),
    "cot": (_P, "round(cot(p_size), 9)", None),
    "factorial": (_P, "CAST(factorial(p_size % 15) AS BIGINT)", None),
    "gcd": (_P, "CAST(gcd(p_size, p_partkey) AS BIGINT)", None),
    "lcm": (_P, "CAST(lcm(p_size, p_partkey) AS BIGINT)", None),
    "iszero": (_P, "iszero(p_size % 5)", "p_size % 5 = 0"),
    "log": (_P, "round(log(p_size), 9)", "round(log10(p_size), 9)"),
    "log_base": (_P, "round(log(3, p_size + 1), 9)", "round(ln(p_size + 1) / ln(3), 9)"),
    "isnan": (_P, "isnan(CASE WHEN p_size % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_size % 4 = 1 THEN NULL ELSE p_retailprice END)", None),
    "nanvl": (_P, "nanvl(CASE WHEN p_size % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_size % 4 = 1 THEN NULL ELSE p_retailprice END, 7.5)", "CASE WHEN p_size % 4 = 0 THEN 7.5 WHEN p_size % 4 = 1 THEN NULL ELSE p_retailprice END"),
    "pi": (_N, "round(pi(), 12)", None),
    "power": (_P, "CAST(power(p_size % 9, 5) AS BIGINT)", None),
    "round": (_P, "round(p_retailprice, 1)", None),
    "signum": (_C, "signum(c_acctbal)", "CAST(sign(c_acctbal) AS DOUBLE)"),
    "trunc": (_C, "trunc(c_acctbal)", None),
    "trunc_places": (_C, "round(trunc(c_acctbal / 7, 2), 2)", "round(sign(c_acctbal) * floor(abs(c_acctbal / 7) * 100) / 100, 2)"),
    **{f: (_P, f"round({f}((p_size - 25) / 26.0), 9)", None) for f in ("acos", "asin", "atan", "sin", "cos", "tan", "exp", "degrees", "radians", "atanh", "asinh", "sinh", "cosh", "tanh", "cbrt")},
    "acosh": (_P, "round(acosh(p_size + 1.5), 9)", None),
    "atan2": (_P, "round(atan2(p_size, p_retailprice), 9)", None),
    "ceil": (_C, "ceil(c_acctbal)", None),
    "floor": (_C, "floor(c_acctbal)", None),
    "ln": (_P, "round(ln(p_size), 9)", None),
    "log2": (_P, "round(log2(p_size), 9)", None),
    "log10": (_P, "round(log10(p_size), 9)", None),
    "sqrt": (_P, "round(sqrt(p_retailprice), 9)", None),
    "integer_division": (_P, "p_partkey / p_size", "p_partkey // p_size"),
    "arithmetic": (_P, "round(-p_retailprice + p_size * 2 - p_partkey % 7 / 2.0, 6)", None),
    "bitwise": (_P, "CAST((p_size & 12) | (p_size # 5) AS BIGINT) + (p_partkey << 2) - (p_partkey >> 1)", "CAST((p_size & 12) | xor(p_size, 5) AS BIGINT) + (p_partkey << 2) - (p_partkey >> 1)"),
    # dates
    "date_bin": (_E, "date_bin(INTERVAL '15 minutes', ts)", "time_bucket(INTERVAL '15 minutes', ts)"),
    "date_bin_origin": (_E, "date_bin(INTERVAL '1 day', ts, TIMESTAMP '2020-01-01 06:00:00')", "time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2020-01-01 06:00:00')"),
    **{f"date_part_{p}": (_L, f"CAST(date_part('{p}', o_orderdate) AS BIGINT)", None) for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "doy", "epoch")},
    "date_part_second": (_E, "CAST(date_part('second', ts) AS BIGINT)", None),
    "date_part_millisecond": (_E, "CAST(date_part('millisecond', ts) AS BIGINT)", None),
    "date_part_microsecond": (_E, "CAST(date_part('microsecond', ts) AS BIGINT)", None),
    "extract": (_L, "CAST(EXTRACT(month FROM o_orderdate) AS BIGINT)", None),
    **{f"date_trunc_{p}": (_E, f"date_trunc('{p}', ts)", f"CAST(date_trunc('{p}', ts) AS TIMESTAMP)") for p in ("year", "month", "week", "day", "hour", "minute")},
    "from_unixtime": (_P, "CAST(from_unixtime(p_partkey * 86461) AS TIMESTAMP)", "CAST(to_timestamp(p_partkey * 86461) AT TIME ZONE 'UTC' AS TIMESTAMP)"),
    "make_date": (_P, "make_date(2000 + p_size, 1 + p_size % 12, 1 + p_size % 28)", None),
    "to_char": (_L, "to_char(o_orderdate, '%Y/%m/%d %H:%M')", "strftime(o_orderdate, '%Y/%m/%d %H:%M')"),
    "to_date": (_L, "to_date(to_char(o_orderdate, '%d.%m.%Y'), '%Y-%m-%d', '%d.%m.%Y')", "CAST(o_orderdate AS DATE)"),
    "to_local_time": (_E, "to_local_time(ts)", "ts"),
    "to_timestamp": (_L, "CAST(to_timestamp(to_char(o_orderdate, '%d.%m.%Y %H'), '%d.%m.%Y %H') AS TIMESTAMP)", "date_trunc('hour', o_orderdate)"),
    "to_timestamp_seconds": (_E, "CAST(to_timestamp_seconds(ts) AS TIMESTAMP)", "CAST(date_trunc('second', ts) AS TIMESTAMP)"),
    "to_timestamp_millis": (_P, "CAST(to_timestamp_millis(p_partkey * 86461123) AS TIMESTAMP)", "CAST(epoch_ms(p_partkey * 86461123) AS TIMESTAMP)"),
    "to_timestamp_micros": (_P, "CAST(to_timestamp_micros(p_partkey * 86461123456) AS TIMESTAMP)", "make_timestamp(p_partkey * 86461123456)"),
    "to_timestamp_nanos": (_P, "CAST(to_timestamp_nanos(p_partkey * 86461123456789) AS TIMESTAMP)", "make_timestamp(p_partkey * 86461123456789 // 1000)"),
    "to_unixtime": (_E, "to_unixtime(ts)", "CAST(floor(epoch(ts)) AS BIGINT)"),
    "interval_arithmetic": (_L, "o_orderdate + INTERVAL '3 days' - INTERVAL '2 hours'", None),
    # core
    "arrow_cast": (_P, "arrow_cast(p_size, 'Float64')", "CAST(p_size AS DOUBLE)"),
    "arrow_typeof": (_P, "arrow_typeof(p_size)", "'Int32'"),
    "cast_operator": (_P, "p_size::varchar || p_retailprice::int::text", "CAST(p_size AS VARCHAR) || CAST(CAST(trunc(p_retailprice) AS INT) AS VARCHAR)"),
    "try_cast": (_P, "TRY_CAST(p_name AS INT)", None),
    "coalesce": (_P, "coalesce(nullif(p_size, 7), p_partkey)", None),
    "get_field": (_P, "get_field(named_struct('a', p_size, 'b', p_name), 'b')", "p_name"),
    "greatest": (_P, "greatest(p_size, nullif(p_partkey % 50, 3), 20)", None),
    "least": (_P, "least(p_size, nullif(p_partkey % 50, 3), 20)", None),
    "named_struct": (_P, "named_struct('a', p_size, 'b', p_name)['a']", "p_size"),
    "struct": (_P, "struct(p_size, p_name)['c1']", "p_name"),
    "struct_literal": (_P, "{a: p_size, b: p_name}['a']", "p_size"),
    "nullif": (_P, "nullif(p_size, 7)", None),
    "nvl": (_P, "nvl(nullif(p_size, 7), -1)", "coalesce(nullif(p_size, 7), -1)"),
    "nvl2": (_P, "nvl2(nullif(p_size, 7), 1, 2)", "CASE WHEN nullif(p_size, 7) IS NOT NULL THEN 1 ELSE 2 END"),
    "union_tag": (_P, "union_tag(named_struct('tag', CASE WHEN p_size > 9 THEN 'i' ELSE 's' END, 'i', p_size, 's', p_name))", "CASE WHEN p_size > 9 THEN 'i' ELSE 's' END"),
    "union_extract": (_P, "union_extract(named_struct('tag', CASE WHEN p_size > 9 THEN 'i' ELSE 's' END, 'i', p_size, 's', p_name), 'i')", "CASE WHEN p_size > 9 THEN p_size END"),
    "case_simple": (_P, "CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END", None),
    "case_searched": (_P, "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'small' END", None),
    "is_predicates": (_P, "(nullif(p_size, 7) > 9) IS TRUE OR (nullif(p_size, 7) > 9) IS UNKNOWN", "coalesce(nullif(p_size, 7) > 9, true)"),
    "is_distinct_from": (_P, "nullif(p_size, 7) IS DISTINCT FROM nullif(p_partkey % 50, 7)", None),
    "null_safe_equal": (_P, "nullif(p_size, 7) <=> nullif(p_partkey % 50, 7)", "nullif(p_size, 7) IS NOT DISTINCT FROM nullif(p_partkey % 50, 7)"),
    "between_in": (_P, "p_size BETWEEN 5 AND 20 AND p_size NOT IN (7, 9) OR p_brand IN ('Brand#11', 'Brand#12')", None),
    # digests and encodings
    "md5": (_P, "md5(p_name)", None),
    "sha224": (_P, "encode(sha224(p_name), 'hex')", None),
    "sha256": (_P, "encode(sha256(p_name), 'hex')", "sha256(p_name)"),
    "sha384": (_P, "encode(sha384(p_name), 'hex')", None),
    "sha512": (_P, "encode(sha512(p_name), 'hex')", None),
    "digest": (_P, "encode(digest(p_name, 'sha256'), 'hex')", "sha256(p_name)"),
    "digest_blake2b": (_P, "encode(digest(p_name, 'blake2b'), 'hex')", None),
    "encode_base64": (_P, "encode(p_name, 'base64')", "rtrim(base64(encode(p_name)), '=')"),
    "encode_hex": (_P, "encode(p_name, 'hex')", "lower(hex(p_name))"),
    "decode_base64": (_P, "CAST(decode(encode(p_name, 'base64'), 'base64') AS VARCHAR)", "p_name"),
    "decode_hex": (_P, "CAST(decode(encode(p_name, 'hex'), 'hex') AS VARCHAR)", "p_name"),
    # arrays
    "array_has": (_P, f"array_has({_ARR}, 3)", None),
    "array_has_all": (_P, "array_has_all([p_size % 4, p_size % 5, 1], [1, 2])", "list_has_all([p_size % 4, p_size % 5, 1], [1, 2])"),
    "array_has_any": (_P, "array_has_any([p_size % 4, p_size % 5], [1, 2])", "list_has_any([p_size % 4, p_size % 5], [1, 2])"),
    "array_contained_operators": (_P, "([p_size % 4, p_size % 5, 1] @> [1, 2]) OR ([p_size % 9] <@ [1, 2])", "list_has_all([p_size % 4, p_size % 5, 1], [1, 2]) OR list_has_all([1, 2], [p_size % 9])"),
    "equals_any": (_P, "p_size = ANY([3, 5, 8])", "p_size IN (3, 5, 8)"),
    "cardinality": (_P, f"CAST(cardinality({_WORDS}) AS BIGINT)", f"len({_DWORDS})"),
    "array_append": (_P, *_list("array_append([p_size, 1], 9)", "list_append([p_size, 1], 9)")),
    "array_prepend": (_P, *_list("array_prepend(9, [p_size, 1])", "list_prepend(9, [p_size, 1])")),
    "array_concat": (_P, *_list(f"array_concat({_ARR}, {_BRR})", f"list_concat({_ARR}, {_BRR})")),
    "array_dims": (_P, *_list("array_dims([[p_size, 2, 3], [4, 5, 6]])", "[2, 3]")),
    "array_ndims": (_P, "CAST(array_ndims([[p_size, 2, 3], [4, 5, 6]]) AS BIGINT)", "CAST(2 AS BIGINT)"),
    "array_distance": ("embeddings vec_id", "round(array_distance(embedding, array_reverse(embedding)), 4)", "round(list_distance(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 4)"),
    "empty": (_P, "empty(array_remove_all([p_size % 3, p_size % 3], 1))", "p_size % 3 = 1"),
    "array_except": (_P, *_list(f"array_sort(array_except({_BRR}, [3, 1]))", f"list_sort(list_distinct(list_filter({_BRR}, lambda e: e NOT IN (3, 1))))")),
    "array_element": (_P, f"array_element({_ARR}, p_size % 7 - 3)", f"CASE WHEN p_size % 7 - 3 = 0 THEN NULL ELSE list_extract({_ARR}, p_size % 7 - 3) END"),
    "subscript": (_P, f"{_WORDS}[2]", f"{_DWORDS}[2]"),
    "array_slice": (_P, *_list(f"{_ARR}[2:4]", f"list_slice({_ARR}, 2, 4)")),
    "array_slice_stride": (_P, *_list("array_slice([1, 2, 3, 4, p_size], 1, 5, 2)", "list_slice([1, 2, 3, 4, p_size], 1, 5, 2)")),
    "array_pop_front": (_P, *_list(f"array_pop_front({_ARR})", f"list_slice({_ARR}, 2, 5)")),
    "array_pop_back": (_P, *_list(f"array_pop_back({_ARR})", f"list_slice({_ARR}, 1, 4)")),
    "array_any_value": (_P, "array_any_value([NULL, nullif(p_size, 7), 3])", "coalesce(nullif(p_size, 7), 3)"),
    "flatten": (_P, *_list("flatten([[p_size, 1], [2], [3, p_size]])", "flatten([[p_size, 1], [2], [3, p_size]])")),
    "array_length": (_P, f"CAST(array_length({_WORDS}) AS BIGINT)", f"len({_DWORDS})"),
    "make_array": (_P, *_list("make_array(p_size, 1, p_partkey)", "[p_size, 1, p_partkey]")),
    "array_max": (_P, f"array_max({_ARR})", f"list_max({_ARR})"),
    "array_min": (_P, f"array_min({_ARR})", f"list_min({_ARR})"),
    "array_position": (_P, f"CAST(array_position({_ARR}, 3) AS BIGINT)", f"CAST(list_position({_ARR}, 3) AS BIGINT)"),
    "array_positions": (_P, *_list(f"array_positions({_ARR}, 3)", f"list_filter([CASE WHEN p_size = 3 THEN 1 END, CASE WHEN p_size % 7 = 3 THEN 2 END, 4, CASE WHEN p_size % 3 = 3 THEN 5 END], lambda e: e IS NOT NULL)")),
    "range": (_P, *_list("range(1, p_size, 5)", "range(1, p_size, 5)")),
    "generate_series": (_P, *_list("generate_series(p_size, 1, -4)", "generate_series(p_size, 1, -4)")),
    "array_remove": (_P, *_list("array_remove([1, p_size % 3, 1, 2], 1)", "[p_size % 3, 1, 2]")),
    "array_remove_n": (_P, *_list("array_remove_n([1, 2, 1, p_size, 1], 1, 2)", "CASE WHEN p_size = 1 THEN [2, 1, 1] ELSE [2, p_size, 1] END")),
    "array_remove_all": (_P, *_list("array_remove_all([1, p_size % 3, 1, 2], 1)", "list_filter([1, p_size % 3, 1, 2], lambda e: e <> 1)")),
    "array_repeat": (_P, *_list("array_repeat(p_brand, p_size % 4)", "list_transform(range(p_size % 4), lambda e: p_brand)")),
    "array_replace": (_P, *_list("array_replace([1, p_size, 1], 1, 99)", "[99, p_size, 1]")),
    "array_replace_n": (_P, *_list("array_replace_n([1, 2, 1, p_size + 9, 1], 1, 99, 2)", "[99, 2, 99, p_size + 9, 1]")),
    "array_replace_all": (_P, *_list("array_replace_all([1, p_size, 1], 1, 99)", "list_transform([1, p_size, 1], lambda e: CASE WHEN e = 1 THEN 99 ELSE e END)")),
    "array_resize": (_P, *_list("array_resize([p_size, 2], 4, 7)", "[p_size, 2, 7, 7]")),
    "array_reverse": (_P, *_list(f"array_reverse({_WORDS})", f"list_reverse({_DWORDS})")),
    "array_union": (_P, *_list("array_sort(array_union([p_size, 3], [3, 4]))", "list_sort(list_distinct([p_size, 3, 4]))")),
    "array_intersect": (_P, *_list("array_intersect([p_size % 5, 3, 2], [3, 4, 2])", "list_sort(list_distinct(list_filter([p_size % 5, 3, 2], lambda e: e IN (3, 4, 2))))")),
    "array_distinct": (_P, *_list("array_distinct([p_size % 3, 1, 2, 1])", "list_sort(list_distinct([p_size % 3, 1, 2, 1]))")),
    "array_sort": (_P, *_list(f"array_sort({_ARR})", f"list_sort({_ARR}, 'ASC', 'NULLS FIRST')")),
    "array_sort_desc": (_P, *_list(f"array_sort({_ARR}, 'DESC', 'NULLS LAST')", f"list_sort({_ARR}, 'DESC', 'NULLS LAST')")),
    "array_to_string": (_P, f"array_to_string({_ARR}, '-', '*')", f"list_aggregate(list_transform({_ARR}, lambda e: coalesce(CAST(e AS VARCHAR), '*')), 'string_agg', '-')"),
    "string_to_array": (_P, *_list("string_to_array(p_name, 'a', '')", "list_transform(string_split(p_name, 'a'), lambda e: nullif(e, ''))")),
    # maps
    "map": (_P, "MAP {'a': p_size, 'b': 2}['a']", "p_size"),
    "map_from_lists": (_P, "CAST(cardinality(map(['x', 'y'], [p_size, 2])) AS BIGINT)", "CAST(2 AS BIGINT)"),
    "map_entries": (_P, "map_entries(MAP {'a': p_size})[1]['value']", "p_size"),
    "map_extract": (_P, *_list("map_extract(MAP {'a': p_size, 'b': 2}, 'a')", "[p_size]")),
    "map_keys": (_P, *_list("map_keys(MAP {'a': p_size, 'b': 2})", "['a', 'b']")),
    "map_values": (_P, *_list("map_values(MAP {'a': p_size, 'b': 2})", "[p_size, 2]")),
    # the pack of Spark-compatible functions
    "spark_sha2": (_P, "sha2(p_name, 256)", "sha256(p_name)"),
    "spark_expm1": (_P, "round(expm1(p_size / 50.0), 9)", "round(exp(p_size / 50.0) - 1, 9)"),
    "spark_hex": (_P, "hex(p_partkey)", "upper(to_hex(p_partkey))"),
    "spark_char": (_P, "char(65 + p_size % 26)", "chr(65 + p_size % 26)"),
    # bound by their kind rather than their value
    "random": (_P, "random() >= 0 AND random() < 1", "true"),
    "uuid": (_P, "CAST(length(uuid()) AS BIGINT)", "CAST(36 AS BIGINT)"),
    "now": (_N, "now() >= TIMESTAMP '2020-01-01 00:00:00' AND now() = current_timestamp()", "true"),
    "current_date": (_N, "current_date() = today()", "true"),
    "current_time": (_N, "CAST(length(current_time()) AS BIGINT)", "CAST(15 AS BIGINT)"),
    "version": (_N, "length(version()) > 0", "true"),
}
#: The oracle has no such function: rows only.
_ROWS_ONLY = {"sha224", "sha384", "sha512", "digest_blake2b"}


def _text(where: str, value: str) -> str:
    table, key = where.split()
    return f"SELECT {key}, {value} AS v FROM {table}"


QUERIES = {f"fn_{name}": in_sql(_text(where, ours)) for name, (where, ours, _) in FUNCTIONS.items()}
ORACLE = {f"fn_{name}": _text(where, theirs or ours) for name, (where, ours, theirs) in FUNCTIONS.items() if name not in _ROWS_ONLY}
