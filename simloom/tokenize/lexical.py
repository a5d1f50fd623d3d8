"""A table-driven tokeniser for languages of keywords and braces.

Comments and strings are skipped, keywords give a token of their type, a brace opens a block named by the keyword
before it and closes it with an end token, names before a parenthesis are calls, and assignment operators are
assignments. Names and values give no token, so renaming and reformatting change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from simloom.tokenize import comments
from simloom.tokenize.base import ParseError, Tok


@dataclass(frozen=True)
class Lexicon:
    """Keywords by the type they give; keywords whose block is named; whether unbalanced braces are an error."""

    keywords: dict[str, str]
    blocks: tuple[str, ...] = ()
    style: comments.Settings = field(default=comments.C_LIKE)
    name: str = r"[^\W\d]\w*"
    braces: tuple[str, str] = ("{", "}")
    calls: bool = True
    assignments: tuple[str, ...] = ("<<=", ">>=", "**=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ":=", "=")
    steps: tuple[str, ...] = ("++", "--")


#: Operators that hold an equals sign but assign nothing.
COMPARE = ("===", "!==", "==", "!=", "<=", ">=", "=>", "=~", "->", "<-")


def tokenize(text: str, lex: Lexicon) -> list[Tok]:
    skip = comments._pattern(lex.style).pattern
    skip = re.sub(r"\(\?P<\w+>", "(?:", skip)
    compare = [c for c in COMPARE if c not in lex.assignments]
    ops = "|".join(map(re.escape, sorted({*compare, *lex.assignments, *lex.steps}, key=len, reverse=True)))
    pattern = re.compile(rf"(?P<skip>{skip})|(?P<name>{lex.name})|(?P<open>{re.escape(lex.braces[0])})|(?P<close>{re.escape(lex.braces[1])})|(?P<op>{ops})|(?P<end>;)|(?P<nl>\n)", re.S)
    out: list[Tok] = []
    stack: list[str] = []
    pending = ""
    line, start = 1, 0
    for m in pattern.finditer(text):
        at, kind = (line, m.start() - start + 1, m.end() - m.start()), m.lastgroup
        if kind == "skip":
            if n := m[0].count("\n"):
                line, start = line + n, m.start() + m[0].rindex("\n") + 1
        elif kind == "nl":
            line, start = line + 1, m.end()
        elif kind == "name":
            word = m[0]
            if word in lex.keywords:
                out.append(Tok(lex.keywords[word], *at))
                if word in lex.blocks:
                    pending = lex.keywords[word]
            elif lex.calls and re.compile(r"\s*\(").match(text, m.end()):
                out.append(Tok("APPLY", *at))
        elif kind == "open":
            stack.append(pending or "BLOCK")
            out.append(Tok(stack[-1] + "_BEGIN", *at))
            pending = ""
        elif kind == "close":
            if not stack:
                raise ParseError(f"line {line}: {m[0]} closes nothing")
            out.append(Tok(stack.pop() + "_END", *at))
        elif kind == "op" and (m[0] in lex.assignments or m[0] in lex.steps):
            out.append(Tok("ASSIGN", *at))
        elif kind == "end":
            pending = ""
    if stack:
        raise ParseError(f"{len(stack)} blocks are open at the end")
    return out


def _words(text: str, **renamed: str) -> dict[str, str]:
    return {w: renamed.get(w, w.upper()) for w in text.split()}


_COMMON = "if else for while do switch case default break continue return"
_OO = "class interface enum new this super try catch finally throw import package"

LEXICONS = {
    "java": Lexicon(_words(f"{_COMMON} {_OO} throws assert synchronized record yield instanceof extends implements"), tuple("class interface enum if else for while do switch try catch finally synchronized record".split())),
    "cpp": Lexicon(_words(f"{_COMMON} class struct union enum new delete try catch throw goto template namespace using operator typedef"), tuple("class struct union enum if else for while do switch try catch namespace".split())),
    "c": Lexicon(_words(f"{_COMMON} struct union enum goto typedef sizeof"), tuple("struct union enum if else for while do switch".split())),
    "csharp": Lexicon(_words(f"{_COMMON} class struct interface enum new try catch finally throw using namespace foreach lock checked unchecked unsafe fixed delegate event yield goto"), tuple("class struct interface enum if else for foreach while do switch try catch finally namespace lock checked unchecked unsafe fixed using".split())),
    "javascript": Lexicon(_words(f"{_COMMON} class function new try catch finally throw import export yield await async const let var with"), tuple("class function if else for while do switch try catch finally with".split())),
    "golang": Lexicon(_words("if else for switch case default break continue return func struct interface import package go defer select range goto fallthrough map chan type var const"), tuple("if else for switch func struct interface select".split())),
    "kotlin": Lexicon(_words("if else for while do when break continue return class interface object fun try catch finally throw import package companion init constructor val var enum"), tuple("class interface object fun if else for while do when try catch finally companion init".split())),
    "rust": Lexicon(_words("if else for while loop match break continue return fn struct enum trait impl mod use let unsafe async await move type union extern"), tuple("fn struct enum trait impl mod if else for while loop match unsafe union extern".split())),
    "swift": Lexicon(_words("if else for while repeat switch case default break continue return func class struct enum protocol extension import guard defer do catch throw let var init deinit fallthrough"), tuple("if else for while repeat switch func class struct enum protocol extension guard defer do catch init deinit".split())),
    "scala": Lexicon(_words("if else for while do match case return class trait object def val var new try catch finally throw import package yield type extends enum given"), tuple("class trait object if else for while do match try catch finally def enum".split())),
    "rlang": Lexicon(_words("if else for while repeat break next return function in"), tuple("if else for while repeat function".split()), comments.Settings((('"', '"'), ("'", "'")), ("#",), (), ("\\",)), r"[^\W\d][\w.]*", assignments=("<<-", "->>", "<-", "->", "=")),
    "llvmir": Lexicon(_words("define declare ret br switch call invoke load store alloca getelementptr icmp fcmp phi select add sub mul udiv sdiv urem srem shl lshr ashr and or xor fadd fsub fmul fdiv trunc zext sext bitcast ptrtoint inttoptr unreachable resume landingpad global constant type"), ("define",), comments.Settings((('"', '"'),), (";",)), r"[a-z]\w*", calls=False),
    "scheme": Lexicon({w: t for w, t in (("define", "DEFINE"), ("lambda", "LAMBDA"), ("let", "LET"), ("let*", "LET"), ("letrec", "LET"), ("if", "IF"), ("cond", "COND"), ("case", "CASE"), ("and", "AND"), ("or", "OR"), ("begin", "BEGIN"), ("do", "DO"), ("delay", "DELAY"), ("set!", "ASSIGN"), ("quote", "QUOTE"), ("else", "ELSE"))}, ("define", "lambda", "let", "let*", "letrec", "if", "cond", "case", "begin", "do"), comments.LISP, r"[^\s()\[\]\"';]+", ("(", ")"), False, (), ()),
}
LEXICONS["typescript"] = Lexicon(LEXICONS["javascript"].keywords | _words("interface enum namespace type abstract declare"), (*LEXICONS["javascript"].blocks, "interface", "enum", "namespace"))
