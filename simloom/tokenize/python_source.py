"""Python sources by the standard library's syntax tree."""

from __future__ import annotations

import ast

from simloom.tokenize.base import ParseError, Tok

#: Statements and expressions that give one token, and those that give one at each end.
SINGLE = {ast.Assert: "ASSERT", ast.Raise: "RAISE", ast.Return: "RETURN", ast.Yield: "YIELD", ast.YieldFrom: "YIELD", ast.Import: "IMPORT", ast.ImportFrom: "IMPORT", ast.Break: "BREAK", ast.Continue: "CONTINUE", ast.Delete: "DEL", ast.Lambda: "LAMBDA", ast.Assign: "ASSIGN", ast.AugAssign: "ASSIGN", ast.Call: "APPLY", ast.Subscript: "ARRAY", ast.Attribute: "ARRAY", ast.List: "ARRAY", ast.Dict: "ARRAY", ast.Set: "ARRAY", ast.Await: "AWAIT", ast.Try: "TRY_BEGIN", ast.TryStar: "TRY_BEGIN"}
PAIRED = {ast.While: "WHILE", ast.If: "IF", ast.With: "WITH", ast.AsyncWith: "WITH", ast.For: "FOR", ast.AsyncFor: "FOR", ast.ClassDef: "CLASS", ast.FunctionDef: "METHOD", ast.AsyncFunctionDef: "METHOD", ast.ExceptHandler: "EXCEPT"}


def tokenize(text: str) -> list[Tok]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ParseError(str(e)) from e
    out: list[Tok] = []

    def visit(node: ast.AST) -> None:
        kind = type(node)
        at = (getattr(node, "lineno", -1), getattr(node, "col_offset", -2) + 1)
        if isinstance(node, (ast.AsyncFor, ast.AsyncWith, ast.AsyncFunctionDef)):
            out.append(Tok("ASYNC", *at, 5))
        for d in getattr(node, "decorator_list", []):
            out.append(Tok("DEC_BEGIN", d.lineno, d.col_offset + 1, 1))
        if kind in SINGLE or (kind is ast.AnnAssign and node.value is not None):
            out.append(Tok(SINGLE.get(kind, "ASSIGN"), *at, 1))
        if kind in PAIRED:
            out.append(Tok(PAIRED[kind] + "_BEGIN", *at, 1))
        for child in ast.iter_child_nodes(node):
            if getattr(node, "finalbody", None) and child is node.finalbody[0]:
                out.append(Tok("FINALLY", child.lineno, child.col_offset + 1, 1))
            visit(child)
        if kind in PAIRED:
            out.append(Tok(PAIRED[kind] + "_END", node.end_lineno, node.end_col_offset, 1))
        if getattr(node, "decorator_list", []):
            out.append(Tok("DEC_END", node.end_lineno, node.end_col_offset, 1))

    try:
        visit(tree)
    except RecursionError as e:
        raise ParseError("nested too deep") from e
    return out
