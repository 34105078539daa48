"""Bitstream syntax as data: a table of fields, read by one fold over a binary column.

A `Syntax` lists the fields of a structure in coded order.  Each field has a descriptor, a width,
and may have a condition, a value where it is absent, and a check; widths, conditions and checks are
expressions over the names of earlier fields, in SQL that Spark and other dialects share.  Reading
threads a cursor (position in bits, error, values so far) through the fields, so fields that are
absent, or of variable length, shift all that follows.  Everything is a Column expression: no row
leaves the engine, and a query that doesn't ask for a structure doesn't read it.

Descriptors:

    f      unsigned, `width` bits             su     two's complement, `width` bits
    uvlc   Exp-Golomb code                    svlc   the same, signed
    ns     non-symmetric code below `width`   rg     Rice code with `width` low bits
    leb    LEB128 number                      unary  ones up to a zero, `width` at most
    let    no bits: the value of `width`      cover  ns codes of sizes, up to `width` in all, each
    widest no bits: the largest size of the          at most `cap`; the value is their number
           list `cap`, of `width` in all             and `@name` the list of starts
    list   `width` numbers of `cap` bits each; the value is how many, `@name` the numbers

`here` stands for the cursor's place in bits.

A state is struct<pos, error, v, lists>.  The first fault ends the reading: pos is then the place of
the field that couldn't be read, and error says `eof:field`, `code:field` (malformed code) or
`range:field` (a check fails).  Fields behind it are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that one fold looks through; a longer table is a chain of folds.
BLOCK = 24
#: Sizes that `cover` reads at most.
MOST_SIZES = 64

NAME = re.compile(r"@?[A-Za-z_][A-Za-z_0-9]*")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "f"
    width: int | str = 1
    when: str | None = None
    absent: int | None = None
    check: str | None = None
    cap: str | None = None


def flag(name: str, when: str | None = None, absent: int | None = None) -> Field:
    return Field(name, "f", 1, when, absent)


def tile_log2(size: str, target: str, most: int = 22) -> str:
    """SQL for the least k with size << k >= target."""
    return "(" + " + ".join(f"cast(({size}) * {1 << k} < ({target}) as int)" for k in range(most)) + ")"


def _window(p: str, data: str) -> str:
    """56 bits from the byte that holds bit p, zeros behind the end."""
    return f"cast(conv(rpad(hex(substring({data}, cast(({p}) div 8 as int) + 1, 7)), 14, '0'), 16, 10) as bigint)"


def _bits(p: str, n: str, data: str) -> str:
    return f"(shiftright({_window(p, data)}, cast(56 - ({p}) % 8 - ({n}) as int)) & (shiftleft(1L, cast({n} as int)) - 1))"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _found(value: str, used: str, fault: str = "cast(null as string)") -> str:
    return f"named_struct('value', cast({value} as bigint), 'used', cast({used} as bigint), 'fault', {fault}, 'list', cast(null as array<bigint>))"


def _within(value: str, used: str, code: str = "false") -> str:
    """A read that needs `used` bits of what is left; code says where the bits are no code."""
    return f"if({used} > t.size - s.pos, {_found('null', '0', repr('eof'))}, if({code}, {_found('null', '0', repr('code'))}, {_found(value, used)}))"


def _readers(data: str) -> dict[str, str]:
    """SQL for each descriptor over s (state) and t (size: bits of the payload, n: the field's width, cap)."""
    bits = lambda p, n: _bits(p, n, data)
    zeros = "if(w = 0, 32, 32 - length(bin(w)))"
    uvlc = _let(bits("s.pos", "32"), "w", _let(zeros, "z", f"if(z >= 32 and t.size - s.pos >= 32, {_found('null', '0', repr('code'))}, {_within(bits('s.pos + z + 1', 'z') + ' + shiftleft(1L, z) - 1', '(2 * z + 1)')})"))
    signed = _let(bits("s.pos", "t.n"), "u", _within("if(t.n > 0 and u >= shiftleft(1L, cast(t.n - 1 as int)), u - shiftleft(1L, cast(t.n as int)), u)", "t.n"))
    ns = _let("cast(length(bin(t.n)) as bigint)", "w", _let(f"named_struct('m', shiftleft(1L, cast(w as int)) - t.n, 'u', {bits('s.pos', 'w - 1')})", "a", f"if(a.u < a.m, {_within('a.u', '(w - 1)')}, {_within('2 * a.u - a.m + ' + bits('s.pos + w - 1', '1'), 'w')})"))
    ones = "if(w = 0, 32, 32 - length(bin(w)))"
    unary = _let(f"4294967295 - {bits('s.pos', '32')}", "w", _let(f"least({ones}, t.n)", "c", _within("c", "(c + cast(c < t.n as int))")))
    rice = _let(f"4294967295 - {bits('s.pos', '32')}", "w", _let(ones, "c", _within(f"shiftleft(cast(c as bigint), cast(t.n as int)) + {bits('s.pos + c + 1', 't.n')}", "(c + 1 + t.n)", "c >= 32")))
    leb_step = _let(bits("s.pos + 8 * k", "8"), "b", "if(a.done or a.used + 8 > t.size - s.pos, a, named_struct('value', a.value + shiftleft(b & 127, 7 * k), 'used', a.used + 8, 'done', b < 128))")
    leb = _let(f"aggregate(sequence(0, 7), named_struct('value', 0L, 'used', 0L, 'done', false), (a, k) -> {leb_step})", "x", f"if(not x.done and x.used < 64, {_found('null', '0', repr('eof'))}, {_within('x.value', 'x.used', 'not x.done or x.value >= 4294967296')})")
    cover_code = _let("least(t.n - a.start, t.cap)", "r", _let("cast(length(bin(r)) as bigint)", "w", _let(f"named_struct('m', shiftleft(1L, cast(w as int)) - r, 'u', {bits('s.pos + a.used', 'w - 1')})", "q", f"if(q.u < q.m, named_struct('size', q.u + 1, 'used', w - 1), named_struct('size', 2 * q.u - q.m + {bits('s.pos + a.used + w - 1', '1')} + 1, 'used', w))")))
    cover_step = f"if(a.start >= t.n or a.used > t.size - s.pos, a, {_let(cover_code, 'c', 'named_struct(' + repr('start') + ', a.start + c.size, ' + repr('used') + ', a.used + c.used, ' + repr('starts') + ', concat(a.starts, array(a.start)))')})"
    cover = _let(
        f"aggregate(sequence(1, {MOST_SIZES}), named_struct('start', 0L, 'used', 0L, 'starts', cast(array() as array<bigint>)), (a, k) -> {cover_step})",
        "x",
        f"if(x.used > t.size - s.pos, {_found('null', '0', repr('eof'))}, if(x.start < t.n, {_found('null', '0', repr('range'))}, named_struct('value', cast(size(x.starts) as bigint), 'used', x.used, 'fault', cast(null as string), 'list', x.starts)))",
    )
    items = f"transform(sequence(1, greatest(cast(t.n as int), 1)), k -> {bits('s.pos + (k - 1) * t.cap', 't.cap')})"
    several = f"if(t.n * t.cap > t.size - s.pos, {_found('null', '0', repr('eof'))}, named_struct('value', t.n, 'used', t.n * t.cap, 'fault', cast(null as string), 'list', if(t.n > 0, {items}, cast(array() as array<bigint>))))"
    return {
        "list": several,
        "f": _within(bits("s.pos", "t.n"), "t.n"),
        "su": signed,
        "uvlc": uvlc,
        "svlc": _let(uvlc, "u", f"if(u.fault is not null, u, {_found('if(u.value % 2 = 1, (u.value + 1) div 2, -(u.value div 2))', 'u.used')})"),
        "ns": f"if(t.n < 1, {_found('null', '0', repr('code'))}, {ns})",
        "rg": rice,
        "leb": leb,
        "unary": unary,
        "let": _found("t.n", "0"),
        "widest": _found("t.n", "0"),
        "cover": f"if(t.n < 1 or t.cap < 1, {_found('null', '0', repr('code'))}, {cover})",
    }


def _widest(f: Field) -> str:
    return f"array_max(transform({f.cap}, (x, j) -> coalesce(get({f.cap}, j + 1), {f.width}) - x))"


def _inside(name: str) -> bool:
    return name.startswith("_") or "__" in name


class Syntax:
    """A structure of fields in coded order; names that begin with _, or hold __, are working values and stay inside."""

    def __init__(self, *fields: Field | list[Field]):
        self.fields = [f for part in fields for f in (part if isinstance(part, list) else [part])]
        self.at = {f.name: k for k, f in enumerate(self.fields)}
        self.lists = {f.name: k for k, f in enumerate(f for f in self.fields if f.kind in ("cover", "list"))}
        if len(self.at) != len(self.fields):
            raise ValueError("a field is named twice")

    def _bound(self, text: str, before: int, own: str | None = None) -> str:
        """An expression with the names of earlier fields bound to the state s; own stands for the value being read."""

        def bind(m: re.Match) -> str:
            name = m.group()
            if name.startswith("@"):
                return f"get(s.lists, {self.lists[name[1:]]})"
            if name == "here":
                return "s.pos"
            if own and self.at.get(name) == before:
                return own
            if name in self.at:
                if self.at[name] >= before:
                    raise ValueError(f"{self.fields[before].name} needs {name}, which comes later")
                return f"get(s.v, {self.at[name]})"
            return name

        return NAME.sub(bind, text)

    def _cases(self, block: range, of, default: str) -> str:
        """A value for each field of a block; of(field) is None where the default holds."""
        hits = [(k, of(self.fields[k], k)) for k in block]
        branches = " ".join(f"when {k} then {x}" for k, x in hits if x is not None)
        return f"(case i {branches} else {default} end)" if branches else default

    def _step(self, block: range, data: str) -> str:
        readers = _readers(data)
        kinds = {k: [n for n in block if self.fields[n].kind == k] for k in dict.fromkeys(self.fields[n].kind for n in block)}
        read = "case " + " ".join(f"when i in ({', '.join(map(str, at))}) then {readers[k]}" for k, at in kinds.items()) + " end"
        active = self._cases(block, lambda f, k: f"coalesce({self._bound(f.when, k)}, false)" if f.when else None, "true")
        width = self._cases(block, lambda f, k: None if f.width == 1 else f"cast({self._bound(_widest(f) if f.kind == 'widest' else str(f.width), k)} as bigint)", "1L")
        cap = self._cases(block, lambda f, k: f"cast({self._bound(f.cap, k)} as bigint)" if f.kind in ("cover", "list") else None, "0L")
        absent = self._cases(block, lambda f, k: None if f.absent is None else f"{f.absent}L", "cast(null as bigint)")
        failed = self._cases(block, lambda f, k: f"not coalesce({self._bound(f.check, k, 'r.value')}, false)" if f.check else None, "false")
        name = self._cases(block, lambda f, k: repr(f.name), "''")
        got = f"if({active}, {_let(f'named_struct({repr("size")}, 8L * octet_length({data}), {repr("n")}, {width}, {repr("cap")}, {cap})', 't', read)}, {_found(absent, '0')})"
        fault = f"coalesce(concat(r.fault, ':', {name}), if({failed} and {active}, concat('range:', {name}), null))"
        lists = f"if(r.list is null and i not in ({', '.join(str(self.at[n]) for n in self.lists) or '-1'}), s.lists, concat(s.lists, array(r.list)))"
        new = _let(fault, "e", f"named_struct('pos', if(e is null, s.pos + r.used, s.pos), 'error', e, 'v', concat(s.v, array(if(e is null, r.value, null))), 'lists', {lists})")
        return f"if(s.error is not null, s, {_let(got, 'r', new)})"

    def _folds(self, data: str, state: str, first: str) -> list[str]:
        """SQL for the folds of the table one after the other; `state` names the one before."""
        out, data = [], f"coalesce({data}, X'')"
        for a in range(0, len(self.fields), BLOCK):
            block = range(a, min(a + BLOCK, len(self.fields)))
            out.append(f"aggregate(sequence({block[0]}, {block[-1]}), {state if a else first}, (s, i) -> {self._step(block, data)})")
        return out

    def with_state(self, df: DataFrame, state: str, data: str = "payload", start: str = "0", when: str = "true") -> DataFrame:
        """df with the state behind the last field, for a binary column (null: empty) and a position in bits; where `when` fails nothing is read and the error is `skipped`."""
        first = f"named_struct('pos', cast({start} as bigint), 'error', if({when}, cast(null as string), 'skipped'), 'v', cast(array() as array<bigint>), 'lists', cast(array() as array<array<bigint>>))"
        for fold in self._folds(data, state, first):
            df = df.withColumn(state, F.expr(fold))  # one projection after the other, which the optimizer joins
        return df

    def named(self, state: str) -> Column:
        """struct of the named values of a state column; @lists are arrays."""
        s = F.col(state)
        values = [F.get(s["v"], F.lit(k)).alias(f.name) for k, f in enumerate(self.fields) if not _inside(f.name)]
        values += [F.when(F.size(s["lists"]) > k, F.get(s["lists"], F.lit(k))).alias(f"{n}_starts") for n, k in self.lists.items() if not _inside(n)]
        return F.struct(*values)

    def parsed(self, df: DataFrame, data: str = "payload", name: str = "header", start: str = "0") -> DataFrame:
        """df with name (struct of values), name_error and name_bits (bits read)."""
        out = self.with_state(df, "_state", data, start)
        return out.withColumn(name, self.named("_state")).withColumn(f"{name}_error", F.col("_state.error")).withColumn(f"{name}_bits", F.col("_state.pos") - F.expr(f"cast({start} as bigint)")).drop("_state")
