"""What the functions of the language do, for ``help``."""

USAGE = {
    "map": "map(tbl, expr..., filter:=cond, shards:=n, row:=name): each expression of each row, in turn",
    "filter": "filter(tbl, cond, map:=expr, shards:=n, row:=name): the rows for which the condition holds",
    "firstn": "firstn(tbl, n): the first n rows",
    "pick": "pick(tbl, cond): the first row for which the condition holds, else NA",
    "count": "count(tbl): the number of rows",
    "sort": "sort(tbl, key): ascending by key, NA last; -key for descending, {k1, -k2} for several",
    "minn": "minn(tbl, n, key): the n rows with the smallest keys; all, sorted, if n is negative",
    "reduce": "reduce(tbl, key, |a,b|expr, map:=expr): {key, value} with the values of each key folded by a commutative function",
    "cogroup": "cogroup(tbl, key, map:=expr): {key, value} with the rows, or values, of each key as a table",
    "join": "join({a: tbl, b: tbl, ...}, cond, map:=expr): up to four tables; a.x==b.y inner, ==? left, ?== right, ?==? full",
    "joinbed": "joinbed(tbl, features, chrom:=, start:=, end:= or length:=, map:=|row,feat|expr): rows that overlap a feature",
    "concat": "concat(tbl...): all rows of the tables",
    "flatten": "flatten(tbl..., subshard:=bool): the rows of the tables in tables of one column",
    "gather": "gather(tbl, col..., key:=name, value:=name): one row for each of the columns",
    "spread": "spread(tbl, key:=name, value:=name): the value in a column named by the key, row by row",
    "collapse": "collapse(tbl, col...): neighbouring rows merged while none of the columns has two values",
    "transpose": "transpose(tbl, {key}, {name..., value}): a column for each row of the table in the second column",
    "table": "table(expr...): a table of these rows",
    "table_attrs": "table_attrs(tbl): {name, path} of a table that was read",
    "force": "force(tbl): keep the rows for later uses",
    "read": "read(path, type:=format): tsv, bed, btsv, parquet, bam, or by the path's ending",
    "readdir": "readdir(path): the paths of the files below a folder, by name",
    "write": "write(tbl, path, shards:=n, type:=format): true; what exists stays unless overwriting is on",
    "writecols": "writecols(tbl, path with {{.Name}} or {{.Number}}, gzip:=bool): one file for each column",
    "print": "print(expr..., depth:=n, mode:=`default`, `compact` or `description`): print values",
    "optionalfield": "optionalfield(struct, name, default:=expr): the field, or the default if there is none",
    "contains": "contains(struct, `name`): whether there is such a field",
    "unionrow": "unionrow(x, y): the fields of both; y's value where both have one",
    "isnull": "isnull(x): whether x is NA",
    "isstruct": "isstruct(x): whether x is a struct",
    "istable": "istable(x): whether x is a table",
    "int": "int(x): NA is 0; floats are truncated, dates are seconds since 1970, durations nanoseconds",
    "float": "float(x): NA is 0.0; dates and durations are seconds",
    "string": "string(x): NA is empty",
    "max": "max(x...): the greatest; NA if any is NA",
    "min": "min(x...): the smallest; NA if all are NA",
    "string_len": "string_len(s): bytes",
    "substring": "substring(s, from, to): bytes from (from 0) up to to, exclusive",
    "string_replace": "string_replace(s, old, new): every occurrence",
    "string_has_prefix": "string_has_prefix(s, prefix)",
    "string_has_suffix": "string_has_suffix(s, suffix)",
    "string_count": "string_count(s, part): occurrences that don't overlap",
    "regexp_match": "regexp_match(s, regex): whether the regex occurs in s",
    "regexp_replace": "regexp_replace(s, regex, template): every match; ${1} is a group",
    "sprintf": "sprintf(format, x...): %d, %s, %f and the like; %v for any value",
    "hash64": "hash64(x): a hash that isn't negative",
    "land": "land(x, y): bitwise and",
    "lor": "lor(x, y): bitwise or",
    "isset": "isset(x, y): whether all bits of y are set in x",
}
