"""Rule expressions as column expressions: Python syntax is parsed, never evaluated.

Known are names of columns, conv[0].name (and conv[1].name in rules on pairs), constants, lists, and, or, not, comparisons, in, is None,
arithmetic, len(), indexes, "a if b else c", and the helpers below. Where Python would raise, the expression is null. Helpers that a
language model answers take their answer from the map column ``judged``, by the text of the call: judged["only_talks_about('cars')"].
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Helpers answered by a model, and the type of their answers (fixed values, as are the names of all helpers).
JUDGED = {"language": "string", "tone": "array", "only_talks_about": "boolean", "utterance_index": "int", "responds_in_same_language": "boolean", "semantic_content": "boolean"}
ASSISTANT = ("chatbot", "assistant")


class Unknown(ValueError):
    """An expression that rules don't have."""


def paired_names(source: str) -> set[str]:
    """Names x of conv[0].x and conv[1].x in an expression."""
    return {n.attr for n in ast.walk(ast.parse(source.strip(), mode="eval")) if isinstance(n, ast.Attribute) and Rules._is_conv(n.value)}


class Rules:
    """Compiles expressions on the columns of ``rows``; ``sides``: aliases of the rows that conv[0], conv[1] stand for."""

    def __init__(self, rows: DataFrame, sides: tuple[str, ...] = (), whole: bool = False) -> None:
        self.rows, self.sides, self.whole = rows, sides, whole

    def truth(self, source: str) -> Column:
        """Whether an expression holds, in Python's sense."""
        return self._truth(self._value(self._parse(source)))

    def verdict(self, source: str) -> Column:
        """True only if the value is True (or 1), null where it raises."""
        value = self._value(self._parse(source))
        kind = self._type(value)
        if isinstance(kind, T.BooleanType):
            return value
        return value == 1 if isinstance(kind, T.NumericType) else F.when(value.isNotNull(), False)

    def equalities(self, source: str) -> list[tuple[Column, Column]]:
        """The pairs that "conv[0].a == conv[1].b" parts, joined by "and", make equal."""
        found = []

        def side(node: ast.AST) -> int | None:
            whole = [n.value.slice.value for n in ast.walk(node) if isinstance(n, ast.Attribute) and self._is_conv(n.value)]
            return whole[0] if whole and len(set(whole)) == 1 else None

        def visit(node: ast.AST) -> None:
            if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
                for v in node.values:
                    visit(v)
            elif isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq):
                a, b = node.left, node.comparators[0]
                if {side(a), side(b)} == {0, 1}:
                    found.append((self._value(a), self._value(b)) if side(a) == 0 else (self._value(b), self._value(a)))

        visit(self._parse(source))
        return found

    def _parse(self, source: str) -> ast.AST:
        try:
            return ast.parse(source.strip(), mode="eval").body
        except SyntaxError as e:
            raise Unknown(f"not a rule expression: {source}") from e

    def _type(self, value: Column) -> T.DataType:
        return self.rows.select(value.alias("v")).schema["v"].dataType

    def _truth(self, value: Column) -> Column:
        kind = self._type(value)
        if isinstance(kind, T.BooleanType):
            return value
        if isinstance(kind, T.NumericType):
            return value != 0
        if isinstance(kind, T.StringType):
            return F.coalesce(value != "", F.lit(False))
        if isinstance(kind, T.ArrayType | T.MapType):
            return F.coalesce(F.size(value) > 0, F.lit(False))
        return value.isNotNull()

    @staticmethod
    def _is_conv(node: ast.AST) -> bool:
        return isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "conv" and isinstance(node.slice, ast.Constant)

    def _column(self, name: str, side: int = 0) -> Column:
        if side >= max(1, len(self.sides)):
            raise Unknown(f"conv[{side}] in a rule on {max(1, len(self.sides))}")
        full = f"{self.sides[side]}.{name}" if self.sides else name
        return F.col(full)

    def _value(self, node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=v):
                return F.lit(v)
            case ast.Name(id=name):
                return self._column(name)
            case ast.Attribute(value=inner, attr=name) if self._is_conv(inner):
                return self._column(name, inner.slice.value)
            case ast.List(elts=items) | ast.Tuple(elts=items):
                return F.array(*map(self._value, items))
            case ast.BoolOp(op=op, values=values):
                parts = [self._truth(self._value(v)) for v in values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self._truth(self._value(x))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self._value(x)
            case ast.BinOp(left=a, op=op, right=b):
                return self._arithmetic(self._value(a), op, self._value(b))
            case ast.Compare(left=first, ops=ops, comparators=rest):
                out, left = None, self._value(first)
                for op, right in zip(ops, rest, strict=True):
                    part = self._compare(left, op, right)
                    out, left = part if out is None else out & part, self._value(right)
                return out
            case ast.IfExp(test=test, body=a, orelse=b):
                return F.when(self._truth(self._value(test)), self._value(a)).otherwise(self._value(b))
            case ast.Subscript(value=inner, slice=index):
                found, at = self._value(inner), self._value(index)
                return F.try_element_at(found, at) if isinstance(self._type(found), T.MapType) else F.get(found, F.when(at < 0, at + F.size(found)).otherwise(at).cast("int"))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords):
                return self._call(name, node, args, {k.arg: k.value for k in keywords})
        raise Unknown(f"rules have no {type(node).__name__}: {ast.unparse(node)}")

    def _arithmetic(self, a: Column, op: ast.operator, b: Column) -> Column:
        if isinstance(op, ast.Add):
            return F.concat(a, b) if isinstance(self._type(a), T.StringType | T.ArrayType) else a + b
        whole = {ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.FloorDiv: lambda: F.floor(F.try_divide(a, b)), ast.Mod: lambda: F.pmod(a, F.nullif(b, F.lit(0)))}
        if type(op) not in whole:
            raise Unknown(f"rules have no operator {type(op).__name__}")
        return whole[type(op)]()

    def _compare(self, left: Column, op: ast.cmpop, right: ast.AST) -> Column:
        value = self._value(right)
        match op:
            case ast.Eq() | ast.Is():
                return left.eqNullSafe(value)
            case ast.NotEq() | ast.IsNot():
                return ~left.eqNullSafe(value)
            case ast.Lt():
                return left < value
            case ast.LtE():
                return left <= value
            case ast.Gt():
                return left > value
            case ast.GtE():
                return left >= value
            case ast.In() | ast.NotIn():
                kind = self._type(value)
                if isinstance(kind, T.StringType):
                    found = F.contains(value, left)
                elif isinstance(kind, T.MapType):
                    found = F.map_contains_key(value, left)
                else:
                    found = F.when(value.isNotNull(), F.exists(value, lambda x: x.eqNullSafe(left)))
                return ~found if isinstance(op, ast.NotIn) else found
        raise Unknown(f"rules have no comparison {type(op).__name__}")

    def _call(self, name: str, node: ast.Call, args: list[ast.AST], named: dict[str, ast.AST]) -> Column:
        if name in JUDGED:
            answer = F.try_element_at(self._column("judged"), F.lit(ast.unparse(node)))
            if JUDGED[name] == "array":
                return F.split(answer, ",")
            if JUDGED[name] == "boolean":
                return F.when(answer.isNotNull(), F.lower(answer).isin("true", "yes"))
            return answer.try_cast(JUDGED[name])
        helper: Callable[..., Column] | None = getattr(self, f"_do_{name}", None)
        if helper is None:
            raise Unknown(f"rules have no {name}()")
        return helper(*args, **named)

    def _words(self, node: ast.AST | None, default: str | None = None) -> str | None:
        """The constant text of an argument."""
        if node is None:
            return default
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, str)):
            return node.value
        raise Unknown(f"a constant text is needed: {ast.unparse(node)}")

    def _do_len(self, item: ast.AST) -> Column:
        value = self._value(item)
        return F.length(value) if isinstance(self._type(value), T.StringType) else F.when(value.isNotNull(), F.size(value))

    def _do_extract_float(self, string: ast.AST) -> Column:
        return X.first_float(self._value(string))

    def _do_currency(self, string: ast.AST) -> Column:
        return X.currency(self._value(string))

    def _do_length(self, item: ast.AST, kind: ast.AST | None = None) -> Column:
        """Least or largest length of a text or a list of texts; "average" halves as it goes, as the rules that use it expect: (so far + next) / place."""
        value = self._value(item)
        sizes = F.transform(value if isinstance(self._type(value), T.ArrayType) else F.array(value), F.length)
        how = (self._words(kind, "min") or "").lower()
        return F.when(value.isNotNull(), self._length(sizes, how))

    @staticmethod
    def _length(sizes: Column, how: str) -> Column:
        if how == "average":
            start = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"))
            return F.aggregate(sizes, start, lambda s, x: F.struct(((s["v"] + x) / (s["n"] + 1)).alias("v"), (s["n"] + 1).alias("n")))["v"]
        # of no texts: the values that the search starts from
        if how == "min":
            return F.least(F.coalesce(F.array_min(sizes), F.lit(100_000_000)), F.lit(100_000_000))
        if how == "max":
            return F.coalesce(F.array_max(sizes), F.lit(0))
        raise Unknown(f"length() of kind {how}")

    def _steps(self, *roles: str) -> Column:
        return F.filter(self._column("interaction"), lambda s: F.lower(s["role"]).isin(*roles))

    def _do_conversation_length(self, who: ast.AST | None = None) -> Column:
        role = (self._words(who, "both") or "").lower()
        if role not in ("user", "chatbot", "assistant", "both"):
            raise Unknown(f"conversation_length() of {role}")
        return F.size(self._column("interaction") if role == "both" else self._steps(role))

    def _do_chatbot_returns(self, what: ast.AST, and_not: ast.AST | None = None) -> Column:
        """Places (from 0) of the assistant's texts that hold ``what``, and not ``and_not`` behind it."""
        x, y = self._value(what), None if self._words(and_not) is None else self._value(and_not)
        steps = F.transform(self._column("interaction"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))

        def fits(e: Column) -> Column:
            text = e["s"]["text"]
            at = F.instr(text, x)
            said = F.lower(e["s"]["role"]).isin(*ASSISTANT) & (at > 0)
            return said if y is None else said & (F.position(y, text, at + F.length(x)) == 0)

        return F.transform(F.filter(steps, fits), lambda e: e["i"])

    def _do_repeated_answers(self, method: ast.AST | None = None, threshold: ast.AST | None = None) -> Column:
        """The different texts that the assistant gives more than once, in order; with the method jaccard, of at least ``threshold`` likeness to the first of their kind."""
        how = (self._words(method, "exact") or "").lower()
        texts = F.transform(self._steps(*ASSISTANT), lambda s: s["text"])
        if how == "exact":
            return F.filter(F.array_distinct(texts), lambda t: F.size(F.filter(texts, lambda u: u == t)) > 1)
        if how != "jaccard":
            raise Unknown(f"repeated_answers() by {how}")
        least = float(threshold.value) if isinstance(threshold, ast.Constant) else 0.4
        # heads: first texts of a kind, with how many later ones are like them
        none = F.array().cast("array<struct<text:string,n:int>>")

        def step(heads: Column, text: Column) -> Column:
            like = F.transform(heads, lambda h: X.jaccard(text, h["text"]) >= least)
            at = F.array_position(like, True)
            return F.when(at == 0, F.concat(heads, F.array(F.struct(text.alias("text"), F.lit(0).alias("n"))))).otherwise(
                F.transform(heads, lambda h, i: F.struct(h["text"].alias("text"), (h["n"] + (i + 1 == at).cast("int")).alias("n")))
            )

        return F.transform(F.filter(F.aggregate(texts, none, step), lambda h: h["n"] > 0), lambda h: h["text"])

    def _do_missing_slots(self) -> Column:
        out = self._column("data_output")
        return F.map_keys(F.map_filter(out, lambda k, v: v.isNull() | (v == "None")))

    def _do_data_collected(self) -> Column:
        return F.size(self._do_missing_slots()) == 0

    def _over_all(self, name: str) -> None:
        if not self.whole:
            raise Unknown(f"{name}() is for rules on all conversations")

    def _do_is_unique(self, name: ast.AST) -> Column:
        self._over_all("is_unique")
        column = self._column(self._words(name))
        return F.count(column) == F.count_distinct(column)

    def _do_num_exist(self, condition: ast.AST) -> Column:
        self._over_all("num_exist")
        return F.count_if(Rules(self.rows).truth(self._words(condition)))

    def _do_exists(self, condition: ast.AST) -> Column:
        return self._do_num_exist(condition) > 0
