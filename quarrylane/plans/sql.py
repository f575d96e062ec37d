"""Pieces of SQL that several reference queries share."""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts; the second should be the shorter."""
    return f"""list_reduce([list_transform(range(0, length({b}) + 1), lambda q: 0)] || list_transform(string_split({a}, ''), lambda c: [unicode(c)]),
  lambda prev, ch: list_reduce([[0]] || list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda row, j: list_append(row, CASE WHEN unicode(substr({b}, j[1]::INT, 1)) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(row[len(row)], prev[j[1] + 1]) END)))[length({b}) + 1]"""


def indel(a: str, b: str) -> str:
    """Similarity from 0 to 100 by insertions and deletions alone."""
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sort_ratio(source: str, a: str, b: str, out: str = "sort_ratio") -> str:
    """CTE bodies sr0 and sr: ``source`` with the similarity of the sorted words of columns a and b."""
    one = lambda x: f"array_to_string(list_sort({words(x)}), ' ')"
    return f"sr0 AS (SELECT *, {one(a)} AS sr_a, {one(b)} AS sr_b FROM {source}), sr AS (SELECT * EXCLUDE (sr_a, sr_b), {indel('sr_a', 'sr_b')} AS {out} FROM sr0)"


def set_ratio(source: str, a: str, b: str, out: str = "set_ratio") -> str:
    """CTE bodies st0 to st: ``source`` with the best similarity among the shared words of a and b and these with either rest."""
    text = lambda x: f"array_to_string(list_sort({x}), ' ')"
    return f"""st0 AS (SELECT *, list_distinct({words(a)}) AS st_x, list_distinct({words(b)}) AS st_y FROM {source}),
st1 AS (SELECT *, list_intersect(st_x, st_y) AS st_i, list_filter(st_x, lambda w: NOT list_contains(st_y, w)) AS st_l, list_filter(st_y, lambda w: NOT list_contains(st_x, w)) AS st_r FROM st0),
st2 AS (SELECT *, {text("st_i")} AS st_0, trim({text("st_i")} || ' ' || {text("st_l")}) AS st_1, trim({text("st_i")} || ' ' || {text("st_r")}) AS st_2 FROM st1),
st AS (SELECT * EXCLUDE (st_x, st_y, st_i, st_l, st_r, st_0, st_1, st_2), CASE WHEN len(st_x) = 0 OR len(st_y) = 0 THEN 0.0 WHEN len(st_i) > 0 AND (len(st_l) = 0 OR len(st_r) = 0) THEN 100.0
  ELSE greatest({indel("st_1", "st_2")}, CASE WHEN len(st_i) > 0 THEN greatest({indel("st_1", "st_0")}, {indel("st_2", "st_0")}) ELSE 0.0 END) END AS {out} FROM st2)"""
