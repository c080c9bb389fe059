"""Counts behind the maintainability score, for one unit of a parsed file."""

from __future__ import annotations

import ast
import io
import re
import tokenize

# Nodes without anything to count below them.
_LEAVES = frozenset({ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias})

# Comments, and the strings that have to be passed over to find them.
_COMMENT_OR_STRING = re.compile(
    r"""
    (?P<comment>\#[^\n]*)
    | \'\'\'[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+\'\'\'
    | \"\"\"[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+\"\"\"
    | '[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'
    | "[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"
    """,
    re.VERBOSE | re.DOTALL,
)
# An f-string may hold quotes of its own kind: a # on its line needs the tokenizer.
_HASH_AFTER_FSTRING = re.compile(r"[fF][rR]?['\"][^\n]*\#")


def _without_comments(text: str) -> str:
    if "#" not in text:
        return text
    if not _HASH_AFTER_FSTRING.search(text):
        return _COMMENT_OR_STRING.sub(lambda m: "" if m["comment"] else m[0], text)
    lines = text.split("\n")
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            row, column = token.start
            lines[row - 1] = lines[row - 1][:column]
    return "\n".join(lines)


class LineFacts:
    """Per line of a file: does it hold code, does it hold a comment."""

    def __init__(self, text: str):
        bare = _without_comments(text).split("\n")
        self.code = bytes(bool(line) and not line.isspace() for line in bare)
        self.comments = bytes(line != kept for line, kept in zip(text.split("\n"), bare))

    def count(self, node: ast.stmt, texts: list[ast.Expr]) -> tuple[int, float]:
        """Code lines and comment percentage of a unit.  Free-standing texts, such
        as docstrings, are comments in all their lines.  A comment behind the
        last token does not belong to the unit."""
        first = node.lineno - 1
        marked = bytearray(self.comments[first : node.end_lineno])
        marked[-1] = 0
        code, comments = sum(self.code[first : node.end_lineno]), sum(marked)
        for text in texts:
            code -= sum(self.code[text.lineno - 1 : text.end_lineno])
            comments += marked[text.lineno - 1 - first : text.end_lineno - first].count(0)
        return code, (100.0 * comments / code if code > 0 else 0.0)


class _Tally:
    """Operators and operands after Halstead, decisions after McCabe."""

    def __init__(self):
        self.operators: list[str] = []
        self.operands: list[ast.expr] = []
        self.texts: list[ast.Expr] = []
        self.decisions = 0
        self.functions = 0

    def binary(self, node: ast.BinOp) -> None:
        self.operators.append(type(node.op).__name__)
        self.operands += [node.left, node.right]

    def augmented(self, node: ast.AugAssign) -> None:
        self.operators.append(type(node.op).__name__)
        self.operands += [node.target, node.value]

    def unary(self, node: ast.UnaryOp) -> None:
        self.operators.append(type(node.op).__name__)
        self.operands.append(node.operand)

    def boolean(self, node: ast.BoolOp) -> None:
        self.operators.append(type(node.op).__name__)
        self.operands += node.values
        self.decisions += len(node.values) - 1

    def comparison(self, node: ast.Compare) -> None:
        self.operators += [type(op).__name__ for op in node.ops]
        self.operands += [node.left, *node.comparators]

    def statement(self, node: ast.Expr) -> None:
        if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            self.texts.append(node)

    def function(self, _node: ast.stmt) -> None:
        self.functions += 1

    def branch(self, _node: ast.AST) -> None:
        self.decisions += 1

    def loop(self, node: ast.For | ast.AsyncFor | ast.While) -> None:
        self.decisions += 1 + bool(node.orelse)

    def case(self, node: ast.match_case) -> None:
        wildcard = isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None
        self.decisions += not wildcard or node.guard is not None

    def comprehension(self, node: ast.comprehension) -> None:
        self.decisions += 1 + len(node.ifs)


_RULES = {
    ast.BinOp: _Tally.binary,
    ast.AugAssign: _Tally.augmented,
    ast.UnaryOp: _Tally.unary,
    ast.BoolOp: _Tally.boolean,
    ast.Compare: _Tally.comparison,
    ast.Expr: _Tally.statement,
    ast.FunctionDef: _Tally.function,
    ast.AsyncFunctionDef: _Tally.function,
    ast.If: _Tally.branch,
    ast.IfExp: _Tally.branch,
    ast.Assert: _Tally.branch,
    ast.ExceptHandler: _Tally.branch,
    ast.For: _Tally.loop,
    ast.AsyncFor: _Tally.loop,
    ast.While: _Tally.loop,
    ast.match_case: _Tally.case,
    ast.comprehension: _Tally.comprehension,
}


def _tally(root: ast.AST) -> _Tally:
    """Counts of a unit's own text, which its own decorators are not part of."""
    found = _Tally()
    stack = [root]
    while stack:
        node = stack.pop()
        kind = type(node)
        rule = _RULES.get(kind)
        if rule is not None:
            rule(found, node)
        for name in kind._fields:
            if node is root and name == "decorator_list":
                continue
            value = getattr(node, name, None)
            if type(value) is list:
                stack += [v for v in value if isinstance(v, ast.AST) and type(v) not in _LEAVES]
            elif isinstance(value, ast.AST) and type(value) not in _LEAVES and value._fields:
                stack.append(value)
    return found


def _operand_key(operand: ast.expr):
    if isinstance(operand, ast.Name):
        return "name", operand.id
    if isinstance(operand, ast.Attribute):
        return "attribute", operand.attr
    if isinstance(operand, ast.Constant):
        return "constant", repr(operand.value)
    return "expression", id(operand)


def measure(node: ast.stmt, facts: LineFacts) -> dict:
    found = _tally(node)
    sloc, comment_pct = facts.count(node, found.texts)
    return {
        "n_operators": len(found.operators),
        "n_operands": len(found.operands),
        "u_operators": len(set(found.operators)),
        "u_operands": len({_operand_key(operand) for operand in found.operands}),
        "complexity": max(found.functions, 1) + found.decisions,
        "sloc": sloc,
        "comment_pct": comment_pct,
    }
