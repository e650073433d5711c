"""Word lists, enumerations and language data that results depend on. Stated plainly, in natural order."""

STOPWORDS = """
a an the is are was were be been being do does did doing have has had having
i you he she it we they me him her us them my your his its our their this
that these those to of in on at by for with about against between into
through during before after above below from up down out off over under
again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very
can will just don should now what which who whom or and but if because as
until while
""".split()

PROMPT_FILLER = """
please explain want need help tell show thanks thank let lets like think
know see make sure just also really actually maybe something anything
everything nothing thing things way well okay yes yeah right hmm
""".split()

MACHINE_PROMPT_PREFIXES = [
    "<task-notification>", "<cross-session-message", "<agent-message", "Another Claude session sent a message",
    "A peer session sent a message", "<system-reminder>", "[SYSTEM NOTIFICATION",
]

GENERIC_STEMS = "src lib sources source docs doc test tests spec main index utils util helpers internal app core common base readme package makefile config init setup".split()

COMPOUND_EXTENSIONS = [".blade.php", ".d.ts", ".min.js"]

STATUSES = ["active", "provisional", "superseded", "historical", "declined"]
KINDS = ["adopted", "declined", "reversed", "amended", "restored"]
AUTHORITIES = ["owner-verbatim", "owner-ratified", "agent-inference", "reviewer-finding", "code-derived"]
OWNER_AUTHORITIES = ["owner-verbatim", "owner-ratified"]
EDGE_RELS = ["supersedes", "preserves", "abandons", "challenged_by", "led_to", "applies_to", "depends_on"]
INVARIANT_KINDS = ["no-bypass", "single-definition", "must-call", "pattern-absent"]
RECORD_TYPES = ["topic", "incident", "investigation", "concept"]
CHUNK_KINDS = ["function", "method", "constructor", "accessor", "closure"]

#: language: extensions, shebang stems, noise directories, and what marks a test (directories, directory globs, directory runs, file globs).
LANGUAGES = {
    "swift": ([".swift"], [], ["Tests", "Resources"], ["Tests"], ["*Tests"], [], ["*Tests.swift", "*Test.swift"]),
    "python": ([".py"], ["python", "python3"], ["build", "dist"], ["test", "tests"], [], [], ["test_*.py", "*_test.py", "conftest.py"]),
    "javascript": ([".js", ".jsx", ".mjs", ".cjs"], ["node"], ["build", "dist"], ["test", "__tests__", "tests"], [], [], ["*.test.*", "*.spec.*", "*_spec.*"]),
    "typescript": ([".ts"], [], ["build", "dist"], ["test", "__tests__", "tests"], [], [], ["*.test.*", "*.spec.*", "*_spec.*"]),
    "tsx": ([".tsx"], [], ["build", "dist"], ["test", "__tests__", "tests"], [], [], ["*.test.*", "*.spec.*", "*_spec.*"]),
    "java": ([".java"], [], ["target", "build", "dist"], [], [], ["src/test"], ["*Test.java", "*Tests.java"]),
    "php": ([".php"], [], [], ["test", "tests"], [], [], ["*Test.php", "*Tests.php"]),
    "rust": ([".rs"], [], ["target"], ["tests"], [], [], ["*_test.rs", "tests.rs"]),
    "lua": ([".lua"], ["lua"], [], ["spec", "test", "tests"], [], [], ["*_spec.lua", "*_test.lua"]),
}

#: Citations in prose: a commit by 7 or 40 hex digits after commit, merge, at, as, or in back ticks; the line of a file.
COMMIT = r"\b(?i:commit|merge)\b\s+([0-9a-f]{40}|[0-9a-f]{7})\b|\b(?i:at|as)\b\s+([0-9a-f]{40}|[0-9a-f]{7})\b|`([0-9a-f]{40}|[0-9a-f]{7})`"
PATH_LINE = r"(?<![\w./:\\~-])[A-Za-z0-9_.\-/]+\.[A-Za-z0-9]{1,8}:\d+(?:[-,]\d+)?"
