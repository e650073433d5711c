import pytest

from ledgerloom.sources import code, swift


def names(text):
    return [(c["kind"], c["qualified_name"], c["start_line"], c["end_line"]) for c in swift.scan(text)[0]]


def test_types_qualify_and_are_no_chunks():
    text = "actor Bank {\n  enum `Kind` { case a, b\n    var n: Int { 1 }\n  }\n}\nextension Bank.`Kind` {\n  class final func make() {}\n}\nprotocol P: class {\n  func f()\n  var g: Int { get }\n}"
    assert names(text) == [("accessor", "Bank.Kind.n", 3, 3), ("method", "Bank.Kind.make", 7, 7), ("accessor", "P.g", 11, 11)]
    assert swift.scan(text)[2] == ["Bank", "Kind", "Bank.Kind", "P"]
    assert {"Bank.Kind", "Kind", "make", "Bank.Kind.make"} <= set(code.declared_symbols(text, "swift"))


def test_braces_in_strings_and_comments_count_for_nothing():
    text = 'func a() { let s = "}\\(x.map { "}" }.first ?? "{")" }\nfunc b() { let r = #"\\(} "{"#; /* { /* } */ } */ }\nfunc c() {\n let t = """\n } " {\n """ // }\n}\n'
    assert names(text) == [("function", "a", 1, 1), ("function", "b", 2, 2), ("function", "c", 3, 7)] and swift.scan(text)[1] == []


def test_properties_with_values_or_observers_are_no_chunks():
    text = "class A {\n  lazy var a: Int = { 1 }()\n  var b = 2 { didSet { } }\n  var c: Int {\n    willSet { }\n  }\n  var d: Int\n  {\n    2\n  }\n  var e: Int\n  func f(_ g: () -> Void = {}) { super.init(); self.init(x: 1); if x { } }\n  subscript(i: Int) -> Int { i }\n}"
    assert [n for _, n, _, _ in names(text)] == ["A.d", "A.f", "A.subscript"]


def test_gaps_end_at_the_next_declaration_that_begins_a_line():
    text = "func a() {}\n}\nfoo { }\nx; func no() {}\n@objc public func b() {}\nstruct C {\n  func d() {}\n"
    chunks, gaps, _ = swift.scan(text)
    assert [c["qualified_name"] for c in chunks] == ["a", "b", "C.d"] and gaps == [(2, 5), (6, 8)]
    assert swift.chunk_swift(text)[1] == "partial" and swift.scan("}\n")[1] == [(1, 2)]


def test_doc_and_signature():
    text = "/// One.\n///\n/// Two.\n@objc\nfunc f(\n  a: Int, // first\n  b: String = \"x  y\"\n)   async throws -> [Int] {}\n"
    (c,) = swift.scan(text)[0]
    assert c["doc"] == "One.\n\nTwo." and c["start_line"] == 5 and c["signature"].startswith("func f( a: Int, b: String = ") and c["signature"].endswith(") async throws -> [Int]")


@pytest.mark.parametrize("text", ["", '"', "/*", "func", "class", "init", "{", ")", "func f(", '"\\(', '#"', "`", "var x: Int {", "é ñ \U0001f600 {}"])
def test_torn_text_does_not_raise(text):
    chunks, status = swift.chunk_swift(text)
    assert chunks == [] and status in ("ok", "partial")
    swift.declared_symbols(text)


def test_long_text_takes_linear_time():
    body = "class A {\n" + "  func f(x: Int) -> Int { return x }\n" * 20000 + "\n" * 20000 + "}\n"
    assert len(swift.scan(body)[0]) == 20000


def test_chunks_of_a_tree(spark):
    rows = [("a.swift", b"func f() {}", 11), ("b.swift", b"", 0), ("c.swift", b"func g() {}", 1 << 21)]
    got = {(r["path"], r["symbol"], r["status"]) for r in code.chunks(spark.createDataFrame(rows, "path string, content binary, length long")).collect()}
    assert got == {("a.swift", "f", "ok"), ("b.swift", None, "ok"), ("c.swift", None, "not-indexed: too large")}
