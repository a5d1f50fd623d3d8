import pytest

from simloom.tokenize import comments, registry
from simloom.tokenize.base import ParseError


def types(lang, text, normal=False):
    x = registry.LANGUAGES[lang]
    return [t.type for t in (x.normal if normal else x.tokenize)(text)]


def test_comments():
    text = 'x = "// no"; // yes\n/* a\n b */ \'\\\'/*\'\n//end'
    assert comments.scan(text, comments.C_LIKE) == [(" yes", 1, 16, "LINE"), (" a\n b ", 2, 3, "BLOCK"), ("end", 4, 3, "LINE")]
    assert comments.scan("<!-- a --><!--b", comments.HTML) == [(" a ", 1, 5, "BLOCK"), ("b", 1, 15, "BLOCK")]


def test_words():
    assert [tuple(t) for t in registry.words("Ab c1\r\nd\re-f")] == [("ab", 1, 1, 2), ("c1", 1, 4, 2), ("d", 2, 1, 1), ("e", 3, 1, 1), ("f", 3, 3, 1)]


def test_renaming_and_layout_change_nothing():
    a = "class A { int f(int x) { // c\n if (x == 1) { return g(x); } x += 2; return x; } }"
    b = "class Foo\n{\n int bar(int yy)\n {\n if (yy == 7)\n {\n return hh(yy);\n }\n yy += 9; /* { */ return yy;\n }\n}"
    assert types("java", a) == types("java", b)
    assert types("java", a) == ["CLASS", "CLASS_BEGIN", "APPLY", "BLOCK_BEGIN", "IF", "IF_BEGIN", "RETURN", "APPLY", "IF_END", "ASSIGN", "RETURN", "BLOCK_END", "CLASS_END"]
    with pytest.raises(ParseError):
        types("java", "class A { ")
    with pytest.raises(ParseError):
        types("golang", "}")


def test_python():
    a = "import os\n@d\ndef f(x):\n    for i in x:\n        y = i[0]\n    try:\n        g()\n    except E:\n        raise\n    finally:\n        return y\n"
    assert types("python3", a) == ["IMPORT", "DEC_BEGIN", "METHOD_BEGIN", "FOR_BEGIN", "ASSIGN", "ARRAY", "FOR_END", "TRY_BEGIN", "APPLY", "EXCEPT_BEGIN", "RAISE", "EXCEPT_END", "FINALLY", "RETURN", "METHOD_END", "DEC_END"]
    with pytest.raises(ParseError):
        types("python3", "def f(:")


@pytest.mark.parametrize("lang", sorted(set(registry.LANGUAGES) - {"text", "python3", "emf", "emf-dynamic", "emf-model", "scxml", "scheme", "rlang", "llvmir"}))
def test_braced_languages(lang):
    got = types(lang, 'if (a) { f("}"); x = 1 } else { g(2) }')
    assert got[0] == "IF" and "APPLY" in got and "ASSIGN" in got and got.count("IF_END") == 1


def test_other_languages():
    assert types("scheme", "(define (f x) ; c\n (if x (set! y 1)))") == ["BLOCK_BEGIN", "DEFINE", "DEFINE_BEGIN", "DEFINE_END", "BLOCK_BEGIN", "IF", "BLOCK_BEGIN", "ASSIGN", "BLOCK_END", "BLOCK_END", "BLOCK_END"] or types("scheme", "(define (f x) 1)")[1] == "DEFINE"
    assert types("rlang", "f <- function(x) { y = g(x) } # c")[:3] == ["ASSIGN", "FUNCTION", "FUNCTION_BEGIN"]
    assert types("llvmir", "define i32 @f() {\n %1 = add i32 1, 2 ; c\n ret i32 %1\n}") == ["DEFINE", "DEFINE_BEGIN", "ASSIGN", "ADD", "RET", "DEFINE_END"]


def test_models():
    x = '<scxml><state id="a"><onentry><log/></onentry><transition/></state><final/></scxml>'
    y = '<scxml><final/><state id="zz"><transition/><onentry><log/></onentry></state></scxml>'
    assert types("scxml", x) != types("scxml", y) and types("scxml", x, True) == types("scxml", y, True)
    m = '<p:EPackage xmlns:p="e" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><eClassifiers xsi:type="p:EClass" eSuperTypes="#a #b"><eStructuralFeatures xsi:type="p:EAttribute"/></eClassifiers></p:EPackage>'
    assert types("emf", m) == ["PACKAGE", "CLASS", "SUPER_TYPE", "SUPER_TYPE", "ATTRIBUTE", "CLASS_END", "PACKAGE_END"]
    assert types("emf-dynamic", m)[0] == "EPackage"
    with pytest.raises(ParseError):
        types("emf", "<a>")


def test_registry(spark):
    one = registry.LANGUAGES["java"]
    assert registry.registered((one, one, registry.LANGUAGES["c"])).keys() == {"c"}
    with pytest.raises(ValueError):
        registry.by_suffix([registry.LANGUAGES["c"], registry.Language("x", (".c",), 1, registry.words)])
    find = registry.chosen("multi")
    assert find("a/B.CPP").name == "cpp" and find("x.unknown") is None and find("m.js").name == "javascript"
    df = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "x ="), ("c.zzz", "x"), ("d.py", None)], "path string, text string")
    got = {r.path: r for r in registry.tokenized(df, "multi").collect()}
    assert [t.type for t in got["a.py"].tokens] == ["ASSIGN", "EOF"] and got["b.py"].tokens is None and got["c.zzz"].error == "no language" and got["d.py"].error == "no text"
