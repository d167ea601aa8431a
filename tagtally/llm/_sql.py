"""SQL text for array work that stays linear in the array: running totals and slices of long texts.

A fold that appends to its own result copies it at every step. Here arrays and texts are cut into blocks of fixed
size first: inside a block the fold's result is bounded, and across blocks it has one number for each block.
"""

from __future__ import annotations

#: Entries of a block of an array, and characters of a piece of a text.
BLOCK, PIECE = 128, 256


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chain(op: str, a: str, b: str) -> str:
    return f"({a} + {b})" if op == "+" else f"greatest({a}, {b})"


def running(values: str, op: str, zero: str, tag: str) -> str:
    """For each place of an int array what ``op`` ('+' or 'greatest') makes of all entries before it; and one for all.

    ``tag`` keeps the names of the lambda variables of nested uses apart.
    """
    v, p, s, o = (f"{x}_{tag}" for x in "vpso")
    fold = lambda items, first: f"aggregate({items}, array({first}), (a_{tag}, x_{tag}) -> array_append(a_{tag}, {_chain(op, f'element_at(a_{tag}, -1)', f'x_{tag}')}))"
    blocks = f"transform(sequence(0, cast(greatest(0, size({v}) - 1) div {BLOCK} as int)), b_{tag} -> slice({v}, b_{tag} * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform({p}, q_{tag} -> aggregate(q_{tag}, {zero}, (y_{tag}, z_{tag}) -> {_chain(op, f'y_{tag}', f'z_{tag}')}))"
    inner = f"flatten(zip_with({p}, slice({o}, 1, size({p})), (q_{tag}, w_{tag}) -> slice({fold(f'q_{tag}', f'w_{tag}')}, 1, size(q_{tag}))))"
    return let(values, v, let(blocks, p, let(sums, s, let(fold(s, zero), o, f"array_append({inner}, element_at({o}, -1))"))))


def pieces(text: str) -> str:
    """A text as an array of pieces of ``PIECE`` code points, for ``part``."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"


def part(held: str, start: str, length: str) -> str:
    """``substring`` of a text by its ``pieces``, from 0; what it reads grows with ``length`` and not with ``start``."""
    first, last = f"cast(({start}) div {PIECE} as int)", f"cast(({start} + {length} - 1) div {PIECE} as int)"
    return f"if({length} <= 0, '', substring(array_join(slice({held}, {first} + 1, greatest(1, {last} - {first} + 1)), ''), ({start}) % {PIECE} + 1, {length}))"
