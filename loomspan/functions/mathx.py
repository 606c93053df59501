"""Bounded mathematics: column expressions where Spark has them, a closed evaluator for expressions in text."""

import ast
import fractions
import math
import operator
import re
import statistics
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of an expression.
MAX_CHARS, MAX_NODES, MAX_DEPTH, MAX_ITEMS, MAX_BITS, MAX_EXPONENT, MAX_FACTORIAL, MAX_N, MAX_ROUND = 1024, 256, 24, 128, 4096, 1000, 500, 1000, 100
#: Largest integer that JSON readers keep exactly.
SAFE_INTEGER = 9007199254740991


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down (Spark's ``div`` rounds towards zero); null for a zero divisor."""
    return F.floor(F.try_divide(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for a zero divisor."""
    return a - b * F.floor(F.try_divide(a, b))


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def safe_log(x: Column, base: Column | None = None) -> Column:
    """Logarithm, null where it doesn't exist; the base comes second."""
    natural = F.when(x > 0, F.log(x))
    return natural if base is None else F.when((base > 0) & (base != 1), natural / F.log(base))


def fold_gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid, 100 steps at most (enough for 64 bits)."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step)["a"]


def falling(n: Column, k: Column) -> Column:
    """n (n-1) ... (n-k+1) as a double."""
    return F.when(k > n, F.lit(0.0)).otherwise(F.aggregate(F.when(k > 0, F.sequence(n - k + 1, n)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda x, i: x * i))


def json_safe(x: Column) -> Column:
    """A number as text in full if it is past what JSON readers keep; give products past 64 bits as decimals."""
    return F.when((x > SAFE_INTEGER) | (x < -SAFE_INTEGER), x.cast("string"))


class _Problem(Exception):
    """Carries the error code of an expression."""


def _whole(x):
    if isinstance(x, bool) or not isinstance(x, int):
        raise _Problem("type_error")
    return x


def _natural(x, most):
    x = _whole(x)
    if not 0 <= x <= most:
        raise _Problem("domain_error")
    return x


def _flat(args):
    items = list(args[0]) if len(args) == 1 and isinstance(args[0], list) else list(args)
    if not 0 < len(items) <= MAX_ITEMS or any(isinstance(x, list) for x in items):
        raise _Problem("argument_error")
    return items


def _exact_mean(xs):
    return fractions.Fraction(sum(map(fractions.Fraction, xs)), len(xs)) if all(isinstance(x, (int, fractions.Fraction)) for x in xs) else math.fsum(xs) / len(xs)


def _many(f, least=1):
    def run(*args):
        xs = _flat(args)
        if len(xs) < least:
            raise _Problem("argument_error")
        return f(xs)

    return run


def _rounded(x, digits=0):
    if abs(_whole(digits)) > MAX_ROUND:
        raise _Problem("domain_error")
    return round(x, digits) if digits else round(x)


_FUNCTIONS = {
    "arithmetic": {"abs": abs, "round": _rounded, "floor": math.floor, "ceil": math.ceil, "trunc": math.trunc, "frac": lambda a, b=1: fractions.Fraction(_whole(a), _whole(b))},
    "aggregate": {"sum": _many(sum), "fsum": _many(math.fsum), "prod": _many(math.prod), "min": _many(min), "max": _many(max)},
    "power": {"sqrt": math.sqrt, "isqrt": lambda x: math.isqrt(_whole(x)), "exp": math.exp, "log": lambda x, b=None: math.log(x) if b is None else math.log(x, b), "log2": math.log2, "log10": math.log10, "hypot": _many(lambda xs: math.hypot(*xs))},
    "trigonometry": {n: getattr(math, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "atan2", "degrees", "radians")},
    "number": {"gcd": _many(lambda xs: math.gcd(*map(_whole, xs))), "lcm": _many(lambda xs: math.lcm(*map(_whole, xs))), "factorial": lambda n: math.factorial(_natural(n, MAX_FACTORIAL)), "comb": lambda n, k: math.comb(_natural(n, MAX_N), _natural(k, MAX_N)), "perm": lambda n, k: math.perm(_natural(n, MAX_N), _natural(k, MAX_N))},
    "statistics": {
        "mean": _many(_exact_mean), "fmean": _many(statistics.fmean), "median": _many(statistics.median), "median_low": _many(statistics.median_low), "median_high": _many(statistics.median_high),
        "pvariance": _many(statistics.pvariance), "pstdev": _many(statistics.pstdev), "variance": _many(statistics.variance, 2), "stdev": _many(statistics.stdev, 2),
    },
}
CATALOG = {name: family for family, members in _FUNCTIONS.items() for name in members}
_CALL = {name: f for members in _FUNCTIONS.values() for name, f in members.items()}
_CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}


def _size(x):
    if isinstance(x, int) and x.bit_length() > MAX_BITS or isinstance(x, fractions.Fraction) and max(x.numerator.bit_length(), x.denominator.bit_length()) > MAX_BITS:
        raise _Problem("numeric_limit")
    if isinstance(x, float) and not math.isfinite(x):
        raise _Problem("numeric_limit")
    if isinstance(x, complex):
        raise _Problem("domain_error")
    return x


def _fails(code: str):
    def run(_):
        raise _Problem(code)

    return run


def _power(a, b):
    if abs(_whole(b)) > MAX_EXPONENT or isinstance(a, int) and a.bit_length() * abs(b) > MAX_BITS:
        raise _Problem("numeric_limit")
    return fractions.Fraction(a) ** b if b < 0 and isinstance(a, int) else a**b


def _quotient(a, b):
    whole = isinstance(a, (int, fractions.Fraction)) and isinstance(b, (int, fractions.Fraction))
    return fractions.Fraction(a) / fractions.Fraction(b) if whole else a / b


def _compiled(node: ast.AST, depth: int, slots: dict[int, int]):
    """A function of the constants' list that gives the node's value; what isn't allowed fails when it is reached."""
    if depth > MAX_DEPTH:
        return _fails("complexity_limit")
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        slot = slots[node.col_offset]
        return lambda constants: _size(constants[slot])
    if isinstance(node, ast.Name) and node.id in _CONSTANTS:
        fixed = _CONSTANTS[node.id]
        return lambda _: fixed
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        inner, apply = _compiled(node.operand, depth + 1, slots), operator.neg if isinstance(node.op, ast.USub) else operator.pos
        return lambda constants: apply(inner(constants))
    if isinstance(node, (ast.List, ast.Tuple)):
        if len(node.elts) > MAX_ITEMS:
            return _fails("complexity_limit")
        items = [_compiled(x, depth + 1, slots) for x in node.elts]
        return lambda constants: [f(constants) for f in items]
    if isinstance(node, ast.BinOp):
        left, right = _compiled(node.left, depth + 1, slots), _compiled(node.right, depth + 1, slots)
        apply = _power if isinstance(node.op, ast.Pow) else _quotient if isinstance(node.op, ast.Div) else _BINARY.get(type(node.op))

        def binary(constants):
            a, b = left(constants), right(constants)
            if type(a) is list or type(b) is list:
                raise _Problem("type_error")
            if apply is None:
                raise _Problem("unsupported_syntax")
            return _size(apply(a, b))

        return binary
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALL and not node.keywords:
        f, args = _CALL[node.func.id], [_compiled(x, depth + 1, slots) for x in node.args]

        def call(constants):
            values = [g(constants) for g in args]
            try:
                return _size(f(*values))
            except TypeError as e:
                raise _Problem("argument_error") from e

        return call
    return _fails("unsupported_syntax")


def _program(text: str):
    """(function of the constants, names of the functions) of a text, or its error code."""
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, MemoryError, RecursionError, ValueError):
        return "syntax_error"
    nodes = list(ast.walk(tree))
    if len(nodes) > MAX_NODES:
        return "complexity_limit"
    constants = sorted((x for x in nodes if isinstance(x, ast.Constant) and type(x.value) in (int, float)), key=lambda x: x.col_offset)
    used = sorted({x.func.id for x in nodes if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in _CALL})
    return _compiled(tree.body, 0, {x.col_offset: i for i, x in enumerate(constants)}), used, [x.value for x in constants]


#: A number that stands alone: no part of a name, no exponent, no leading zero.
_NUMBER = re.compile(r"(?<![\w.])(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?![\w.])")
_SHAPES = 4096


def evaluate_text(text: str | None, programs: dict | None = None) -> dict | None:
    """The value of an arithmetic expression, or an error code; text is parsed, never executed.

    ``programs`` keeps what texts of one shape (the same but for their numbers)
    have in common, so that each shape is parsed once.
    """
    if text is None:
        return None
    out = {"kind": None, "exact": None, "value": None, "approximation": None, "functions": [], "error": None}
    try:
        if len(text) > MAX_CHARS or not text.strip():
            raise _Problem("size_limit")
        bare = text.strip()
        program = constants = None
        if programs is not None and bare.isascii() and "\n" not in bare:
            shape = _NUMBER.sub("#", bare)
            program = programs.get(shape)
            if program is None:
                program = _program(bare)
                # a shape whose every number stands alone; other texts are parsed each time
                if type(program) is str or len(program[2]) != shape.count("#") or len(programs) >= _SHAPES:
                    constants = None if type(program) is str else program[2]
                else:
                    programs[shape] = program
            if constants is None and type(program) is not str:
                constants = [float(x) if "." in x else int(x) for x in _NUMBER.findall(bare)]
        else:
            program = _program(bare)
            constants = None if type(program) is str else program[2]
        if type(program) is str:
            raise _Problem(program)
        x = program[0](constants)
        if isinstance(x, list):
            raise _Problem("type_error")
        if isinstance(x, fractions.Fraction) and x.denominator == 1:
            x = x.numerator
        kind = "float" if isinstance(x, float) else "fraction" if isinstance(x, fractions.Fraction) else "integer"
        try:
            near = float(x)
        except OverflowError:
            near = None
        out |= {"kind": kind, "exact": kind != "float", "value": f"{x:.15g}" if kind == "float" else str(x), "approximation": near, "functions": program[1]}
    except _Problem as e:
        out["error"] = str(e)
    except RecursionError:
        out["error"] = "syntax_error"
    except ZeroDivisionError:
        out["error"] = "division_by_zero"
    except OverflowError:
        out["error"] = "numeric_limit"
    except (ValueError, statistics.StatisticsError):
        out["error"] = "domain_error"
    return out


RESULT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("approximation", T.DoubleType()), T.StructField("functions", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
_ARROW_RESULT = pa.struct([("kind", pa.string()), ("exact", pa.bool_()), ("value", pa.string()), ("approximation", pa.float64()), ("functions", pa.list_(pa.string())), ("error", pa.string())])


@F.arrow_udf(RESULT)
def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`evaluate_text` of a text column, by batches; each task parses a shape of text once."""
    programs: dict = {}
    for batch in batches:
        yield pa.array([evaluate_text(t, programs) for t in batch.to_pylist()], _ARROW_RESULT)


FAMILIES = ("sum_product", "gcd", "comb", "sqrt", "mean", "sin_cos", "floor", "isqrt", "hypot", "log2")


def _terms(i: Column) -> tuple[Column, Column, Column]:
    return 2 + (17 * i) % 997, 2 + (31 * i) % 499, 2 + (13 * i) % 97


def _by_family(i: Column, forms: list[Column]) -> Column:
    out = forms[0]
    for k in range(1, 10):
        out = F.when(i % 10 == k, forms[k]).otherwise(out)
    return out


def workload(i: Column) -> Column:
    """The i-th expression of ten families, as text."""
    a, b, c = _terms(i)
    s = lambda x: x.cast("string")
    forms = [
        F.concat(s(a), F.lit(" + "), s(b), F.lit(" * "), s(c)), F.concat(F.lit("gcd("), s(a), F.lit(", "), s(b), F.lit(")")),
        F.concat(F.lit("comb("), s(c + 10), F.lit(", "), s(c % 5), F.lit(")")), F.concat(F.lit("sqrt("), s(a), F.lit(")")),
        F.concat(F.lit("mean("), s(a), F.lit(", "), s(b), F.lit(", "), s(c), F.lit(")")), F.concat(F.lit("sin("), s(a), F.lit(") + cos("), s(b), F.lit(")")),
        F.concat(F.lit("floor("), s(a), F.lit(" / "), s(b), F.lit(")")), F.concat(F.lit("isqrt("), s(a * b), F.lit(")")),
        F.concat(F.lit("hypot("), s(a), F.lit(", "), s(b), F.lit(")")), F.concat(F.lit("log2(2 ** "), s(c), F.lit(")")),
    ]
    return _by_family(i, forms)


def workload_family(i: Column) -> Column:
    """Name of the family of the i-th expression; null where there is none."""
    return F.when(i.isNotNull(), _by_family(i, [F.lit(x) for x in FAMILIES]))


def workload_value(i: Column) -> Column:
    """Value of the i-th expression by Spark's own functions, without the evaluator."""
    a, b, c = _terms(i)
    k = (c % 5).cast("int")
    own = [
        a + b * c, fold_gcd(a, b), falling((c + 10).cast("int"), k) / F.factorial(k), F.sqrt(a), (a + b + c) / 3, F.sin(a) + F.cos(b),
        F.floor(a / b), F.floor(F.sqrt(a * b)), F.hypot(a, b), F.log2(F.pow(F.lit(2.0), c)),
    ]
    return _by_family(i, [x.cast("double") for x in own])


def agrees(a: Column, b: Column) -> Column:
    """Equal within a relative or absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
