"""String, hash and encoding functions. Python runs only where the JVM has no form, and then on Arrow batches."""

from __future__ import annotations

import base64
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(f, kind: str):
    """A pandas UDF over two string columns; null where either is. Results of repeated pairs are computed once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
            else:
                if (x, y) not in known:
                    known[x, y] = f(x, y)
                out.append(known[x, y])
        return pd.Series(out, dtype=object)

    return run


def _single(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype=object)

    return run


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def damerau_distance(a: str, b: str) -> int:
    """Edits with swaps, unrestricted."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, last = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def jaro_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (y for y, u in zip(b, used) if u))) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_similarity(a: str, b: str) -> float:
    j = jaro_similarity(a, b)
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + n * 0.1 * (1 - j) if j > 0.7 else j


#: Fixed value: the digit of each letter A to Z.
REFINED = "01360240043788015936020505"


def refined_soundex_code(s: str) -> str:
    """First character, then a digit for each, 0 for what is no letter, runs of one digit once."""
    if not s:
        return ""
    out, last = s[0].upper(), ""
    for c in s.upper():
        d = REFINED[ord(c) - 65] if "A" <= c <= "Z" else "0"
        if d != last:
            out += d
        last = d
    return out


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for unequal lengths. In the JVM."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x)))


def damerau_levenshtein(a, b) -> Column:
    return _pairs(damerau_distance, "int")(a, b)


def optimal_string_alignment(a, b) -> Column:
    return _pairs(osa_distance, "int")(a, b)


def jaro(a, b) -> Column:
    return _pairs(jaro_similarity, "double")(a, b)


def jaro_winkler(a, b) -> Column:
    return _pairs(jaro_winkler_similarity, "double")(a, b)


def prefix_length(a, b) -> Column:
    return _pairs(common_prefix, "int")(a, b)


def refined_soundex(s) -> Column:
    return _single(refined_soundex_code)(s)


def base32(s) -> Column:
    return _single(lambda x: base64.b32encode(x.encode()).decode())(s)


#: The digits of base 85, # to & and * to z, and the characters of a line in base 64 and in base 85.
DIGITS85 = bytes([*range(35, 39), *range(42, 123)])
LINE64, LINE85 = 72, 80


def encode85(data: bytes) -> str:
    """Groups of four bytes as five digits, a last group of n bytes as n + 1, each line ended."""
    out = bytearray()
    for i in range(0, len(data), 4):
        group = data[i : i + 4]
        n = int.from_bytes(group, "big")
        digits = []
        for _ in range(len(group) + 1):
            n, d = divmod(n, 85)
            digits.append(DIGITS85[d])
        out += bytes(reversed(digits))
    return _wrapped(out.decode(), LINE85)


def decode85(text: str) -> bytes:
    """Characters that are no digits are passed over."""
    digits = [d for c in text.encode() if (d := DIGITS85.find(c)) >= 0]
    out = b""
    for i in range(0, len(digits), 5):
        n = 0
        for d in digits[i : i + 5]:
            n = n * 85 + d
        size = len(digits[i : i + 5]) - 1
        out += (n & (1 << 8 * size) - 1).to_bytes(size, "big") if size else b""
    return out


def is_85(text: str) -> bool:
    return all(c in DIGITS85 or chr(c).isspace() for c in text.encode())


def _wrapped(text: str, width: int) -> str:
    return "".join(text[i : i + width] + "\n" for i in range(0, len(text), width))


def base64_lines(b) -> Column:
    """Base 64 of a blob in lines, each ended."""
    return _single(lambda x: _wrapped(base64.b64encode(bytes(x)).decode(), LINE64))(b)


def base85(b) -> Column:
    """Base 85 of a blob (or of text in UTF-8)."""
    return _single(lambda x: encode85(x.encode() if isinstance(x, str) else bytes(x)))(b)


def unbase85(s) -> Column:
    return _single(decode85, "binary")(s)


def is_base85(s) -> Column:
    return _single(is_85, "boolean")(s)


def rot13(s: Column) -> Column:
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(s, plain, plain[13:26] + plain[:13] + plain[39:] + plain[26:39])


def zorder(*cols: Column, bits: int = 16) -> Column:
    """Morton code of non-negative integers: their bits in turn, the first column's lowest."""
    out = F.lit(0).cast("bigint")
    for k in range(bits):
        for j, c in enumerate(cols):
            bit = F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, k * len(cols) + j))
    return out


def unzorder(z: Column, k: int, of: int, bits: int = 16) -> Column:
    """The k-th of ``of`` integers in a Morton code."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z.cast("bigint"), i * of + k).bitwiseAND(F.lit(1)), i))
    return out


def title_case(s: Column) -> Column:
    return F.initcap(s)


def has_prefix(s: Column, p: str) -> Column:
    return F.startswith(s, F.lit(p))


def count_of(s: Column, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    return F.when(F.lit(part == ""), 0).otherwise(((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / max(1, len(part))).cast("int"))


def last_index(s: Column, part: str) -> Column:
    """1-based place of the last occurrence, 0 for none."""
    r = F.instr(F.reverse(s), part[::-1])
    return F.when(r == 0, 0).otherwise(F.length(s) - r - len(part) + 2)


def char(*codes: Column | int) -> Column:
    """The text of these code points."""
    one = lambda c: F.decode(F.unhex(F.lpad(F.hex(c if isinstance(c, Column) else F.lit(c)), 8, "0")), "UTF-32")
    return F.concat(*map(one, codes))


def unicode(s: Column) -> Column:
    """The first character's code point; null for empty text."""
    return F.when(s != "", F.conv(F.hex(F.encode(F.substring(s, 1, 1), "UTF-32")), 16, 10).cast("bigint"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two texts begin with alike, in the JVM: the first place that differs."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y) & (x != ""))
    at = F.array_position(same, F.lit(False))
    whole = F.least(F.length(a), F.length(b))
    return F.when(whole == 0, 0).when(at == 0, whole).otherwise(at - 1).cast("int")


def _accents() -> tuple[str, str]:
    """Letters of Latin script with marks, and the letters without them, by Unicode decomposition."""
    pairs = [(chr(c), d[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def unaccent(s: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    with_marks, without = _accents()
    return F.regexp_replace(F.translate(s, with_marks, without), r"\p{Mn}", "")


def uuid_text(s: Column) -> Column:
    """A UUID in any usual spelling (braces, any hyphens, upper case) in its canonical one; null for what is none."""
    digits = F.lower(F.translate(s, "-{}", ""))
    ok = digits.rlike("^[0-9a-f]{32}$") & s.rlike(r"^\{?[0-9A-Fa-f-]+\}?$")
    return F.when(ok, F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def uuid_blob(s: Column) -> Column:
    return F.unhex(F.translate(uuid_text(s), "-", ""))


def zeroblob(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n if isinstance(n, Column) else F.lit(n)))


def randomblob(n: int) -> Column:
    """n random bytes, other ones in each row."""
    # a UUID's version digits aren't random, so UUIDs are hashed
    return F.unhex(F.substring(F.concat(*[F.sha2(F.concat(F.uuid(), F.uuid(), F.uuid()), 256) for _ in range(-(-n // 32))]), 1, 2 * n))


def uint_key(s: Column) -> Column:
    """A key whose order is text order, except that runs of digits compare as numbers of any length."""
    runs = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    # a run's length goes before its digits
    number = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    part = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(r)).cast("string"), 9, "0"), number(r))).otherwise(r)
    return F.array_join(F.transform(runs, part), "")


def mixed_format(fmt: str, *values: Column) -> Column:
    """printf: %d %i %u %s %f %e %g %x %X %o %c %q %Q %w %%, flags - + space 0 # ! and , (thousands), width and precision (* takes the next value); a value
    that is missing is 0 or empty. Parts are built one by one, in the JVM."""
    left = list(values)
    parts: list[Column] = []

    def take(empty) -> Column:
        return left.pop(0) if left else F.lit(empty)

    def padded(x: Column, width: Column | None, flags: str) -> Column:
        if width is None:
            return x
        w = F.abs(width)
        back = F.lit("-" in flags) | (width < 0)
        return F.when(F.length(x) >= w, x).when(back, F.rpad(x, w, F.lit(" "))).otherwise(F.lpad(x, w, F.lit(" ")))

    for lit, flags, width, precision, code in re.findall(r"([^%]+)|%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:ll|l)?([diusfeEgGxXocqQwnp%])", fmt):
        if lit:
            parts.append(F.lit(lit))
            continue
        if code in "%n":
            parts.append(F.lit("%" if code == "%" else ""))
            continue
        w = take(0).cast("int") if width == "*" else F.lit(int(width)) if width else None
        p = take(0).cast("int") if precision == "*" else F.lit(int(precision)) if precision else None
        if code in "sqQwc":
            x = take("").cast("string")
            if code == "c":
                x = F.substring(F.coalesce(x, F.lit("")), 1, 1)
            elif p is not None:
                x = F.substring(x, F.lit(1), p)
            if code == "Q":
                x = F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
            elif code in "qw":
                x = F.replace(F.coalesce(x, F.lit("")), F.lit("'" if code == "q" else '"'), F.lit("''" if code == "q" else '""'))
            parts.append(padded(F.coalesce(x, F.lit("")), w, flags))
            continue
        if code in "diuxXop":
            x = F.coalesce(take(0).cast("bigint"), F.lit(0).cast("bigint"))
            kind = {"i": "d", "u": "d", "p": "x"}.get(code, code)
            spec = "".join(c for c in flags if c in "+ ," and kind == "d")
            body = F.format_string(f"%{spec}{kind}", x)
        else:
            x = F.coalesce(take(0).cast("double"), F.lit(0.0))
            spec = "".join(c for c in flags if c in "+ ,")
            if code in "gG":
                body = _general(x, p)
            else:
                digits = F.lit(6) if p is None else p
                # a precision that is a column needs a format for each value
                plain = [F.format_string(f"%{spec if code == 'f' else spec.replace(',', '')}.{k}{code}", x) for k in range(25)]
                body = plain[int(precision)] if precision and precision != "*" and int(precision) < 25 else plain[6] if p is None else F.element_at(F.array(*plain), digits + 1)
        if "0" in flags and "-" not in flags and w is not None:
            sign = F.regexp_extract(body, "^[-+ ]?", 0)
            rest = F.substring(body, F.length(sign) + 1, F.length(body))
            room = F.greatest(F.abs(w) - F.length(sign), F.length(rest))
            body = F.concat(sign, F.lpad(rest, room, F.lit("0")))
        parts.append(padded(body, w, flags))
    return F.concat(*parts) if parts else F.lit("")


def _general(x: Column, p: Column | None) -> Column:
    """%g: as many significant digits as asked for (six), without trailing zeros; very large and small ones with an exponent."""
    digits = F.lit(6) if p is None else F.greatest(p, F.lit(1))
    every = F.array(*[F.format_string(f"%.{k}e", x) for k in range(17)])
    e = F.element_at(every, F.least(digits, F.lit(17)))
    exponent = F.regexp_extract(e, "e([-+][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_extract(e, "^(.*)e", 1)
    short = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    decimals = F.array(*[F.format_string(f"%.{k}f", x) for k in range(22)])
    fixed = F.element_at(decimals, F.least(F.greatest(digits - exponent, F.lit(1)), F.lit(22)))
    return F.when((exponent < -4) | (exponent >= digits), F.concat(short(mantissa), F.regexp_extract(e, "(e[-+][0-9]+)$", 1))).otherwise(short(fixed))


def weighted_distance(a: str, b: str, costs: dict[tuple[str, str], int], insert: int = 100, delete: int = 100, substitute: int = 150) -> int:
    """The least cost to turn a into b. ``costs`` prices replacing one piece of text by another, either of which may be empty; characters
    without a price have the general ones."""
    n, m = len(a), len(b)
    best = [[math.inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            here = best[i][j]
            if here == math.inf:
                continue
            if i < n and j < m:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], here + (0 if a[i] == b[j] else substitute))
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], here + delete)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], here + insert)
            for (x, y), cost in costs.items():
                if a.startswith(x, i) and b.startswith(y, j) and (x or y):
                    best[i + len(x)][j + len(y)] = min(best[i + len(x)][j + len(y)], here + cost)
    return int(best[n][m])


def edit_distance3(a, b, costs: dict[tuple[str, str], int]) -> Column:
    """Edit distance by a table of costs; null where either is."""
    return _pairs(lambda x, y: weighted_distance(x, y, costs), "int")(a, b)


#: Latin spellings of Greek and Cyrillic letters, in the order of the letters from U+03B1 to U+03C9 and U+0430 to U+044F.
GREEK = "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()
CYRILLIC = "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch ' y ' e yu ya".split()


def transliterate(s: Column) -> Column:
    """Text in ASCII: marks go, Greek and Cyrillic letters are spelt in Latin ones, what else isn't ASCII becomes a question mark."""
    table = {chr(0x3B1 + i): v for i, v in enumerate(GREEK)} | {chr(0x430 + i): v for i, v in enumerate(CYRILLIC)} | {"\u00df": "ss", "\u00e6": "ae", "\u00f8": "o", "\u0111": "d", "\u0142": "l", "\u0153": "oe"}
    table |= {x: table[y] for x in map(chr, range(0x370, 0x400)) if (y := unicodedata.normalize("NFD", x)[0]) != x and y in table}
    table |= {k.upper(): v.capitalize() for k, v in table.items() if len(k.upper()) == 1 and k.upper() != k}
    plain = unaccent(s)
    for k, v in table.items():  # as many as there are letters
        plain = F.replace(plain, F.lit(k), F.lit(v))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "?")


#: ISO 15924 numbers of scripts.
SCRIPTS = {"Latin": 215, "Greek": 200, "Cyrillic": 220, "Hebrew": 125, "Arabic": 160}


def script_code(s: Column) -> Column:
    """The number of the one script of a text's letters; 998 for several, 999 for none known."""
    has = [(F.when(s.rlike(rf"\p{{Is{name}}}"), n)) for name, n in SCRIPTS.items()]
    found = F.array_compact(F.array(*has))
    return F.when(s.isNull(), None).when(F.size(found) == 0, 999).when(F.size(found) > 1, 998).otherwise(F.get(found, F.lit(0)))


def casefold(s: Column) -> Column:
    """Text for comparison without regard to case: lower case of upper case, sharp s as ss."""
    return F.replace(F.lower(F.upper(s)), F.lit("\u00df"), F.lit("ss"))
