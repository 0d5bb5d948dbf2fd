"""Intents and their groups, failure modes, message classes. They must equal the published taxonomy."""

from __future__ import annotations

#: Base intents of each category.
CATEGORY_INTENTS = {
    "read": ["read-file-full", "read-file-range", "read-file-full(truncated)", "read-test-file", "read-config-file", "read-via-bash", "read-via-inline-script"],
    "search": ["view-directory", "list-directory", "search-keyword", "search-files-by-name", "search-files-by-content", "inspect-file-metadata", "check-version"],
    "reproduce": ["create-repro-script", "run-repro-script", "run-inline-snippet"],
    "edit": ["edit-source", "insert-source", "apply-patch", "create-file", "edit-via-inline-script", "create-file-via-inline-script"],
    "verify": ["run-test-suite", "run-test-specific", "create-test-script", "run-verify-script", "create-verify-script", "edit-test-or-repro", "run-custom-script", "syntax-check", "compile-build", "run-inline-verify"],
    "git": ["git-diff", "git-status-log", "git-stash"],
    "housekeeping": ["file-cleanup", "create-documentation", "start-service", "install-deps", "check-tool-exists"],
    "failed": ["search-keyword(failed)", "read-via-bash(failed)", "run-script(failed)", "run-test-suite(failed)", "bash-command(failed)"],
    "other": ["submit", "empty", "echo", "bash-other", "undo-edit"],
}
#: What transcripts add; run-inline-snippet counts as verify there.
SESSION_INTENTS = {
    "failed": ["read-file-failed", "edit-source(failed)", "edit-test-or-repro(failed)"],
    "verify": ["run-inline-snippet"],
    "search": ["web-search"],
    "housekeeping": ["tmux-session"],
    "other": ["fetch-url"],
    "git": ["git-github-context", "git-repo-inspect", "git-diff-review", "git-sync-integrate", "git-local-state-change", "git-publish"],
}
#: Letters of the categories, in their canonical order.
LETTERS = {"read": "R", "search": "S", "reproduce": "P", "edit": "E", "verify": "V", "git": "G", "housekeeping": "H", "failed": "X", "other": "O"}
#: Phases; failed and other belong to none.
PHASES = {"understand": ["read", "search"], "reproduce": ["reproduce"], "edit": ["edit"], "verify": ["verify"], "cleanup": ["git", "housekeeping"]}
#: Failure modes of each family.
FAILURES = {
    "tool": [
        "apply_patch_cmd_not_found", "apply_patch_shell_syntax", "apply_patch_other", "bash_trailing_brace", "bash_quote_nesting", "bash_history_expansion",
        "bash_heredoc_unterminated", "bash_command_not_found", "bash_syntax_error", "bash_broken_pipe", "strep_no_match", "strep_multiple_matches",
        "strep_file_not_found", "strep_invalid_range", "strep_create_exists",
    ],
    "code": ["py_module_not_found", "py_syntax_error", "py_indentation_error", "py_traceback_other", "node_error"],
    "test": ["test_failed", "test_collection_error"],
}
#: Intent groups of the sequence layer.
VERIFY_STEPS = ["run-test-suite", "run-test-specific", "run-verify-script", "run-custom-script", "compile-build", "syntax-check", "run-inline-verify"]
REPRO_STEPS = ["run-repro-script", "run-inline-snippet", "read-via-inline-script"]
EDIT_STEPS = ["edit-source", "insert-source", "apply-patch", "edit-test-or-repro", "create-file", "edit-via-inline-script", "create-file-via-inline-script"]
SOURCE_EDIT_STEPS = ["edit-source", "insert-source", "apply-patch", "edit-via-inline-script"]
FAILED_VERIFY_STEPS = ["run-test-suite(failed)", "run-script(failed)"]
READ_STEPS = ["read-file-full", "read-file-range", "read-file-full(truncated)", "read-test-file", "read-config-file", "read-via-bash"]
SEARCH_STEPS = ["search-keyword", "search-files-by-name", "search-files-by-content", "search-keyword(failed)"]
#: Names of configuration files.
CONFIG_FILES = ["package.json", "pytest.ini", "setup.cfg", "setup.py", "go.mod", "makefile", "config.json"]
#: Patterns that tell what inline code does, in any case of letters.
SNIPPET_WRITES = [r"write_text", r"\.write\(", r"open\(.+['\"]w['\"]", r"writefilesync", r"writefile\s*\("]
SNIPPET_READS = [r"read_text", r"\.read\(", r"open\(.+['\"]r['\"]", r"readfilesync", r"readfile\s*\("]
SNIPPET_CHANGES = [r"\.replace\(", r"re\.sub\("]
SNIPPET_ASSERTS = [r"\bassert\s", r"\bassert\(", r"assertequal", r"asserttrue", r"\.tobe\(", r"\.toequal\(", r"\bexpect\("]
SNIPPET_PRINTS = [r"print\(", r"console\.log"]
SNIPPET_VERSIONS = [r"--version\b", r"-v\b", r"sys\.version", r"node\s+-v", r"npm\s+-v"]
#: Import lines of inline code; the first at the beginning of a line and as it is written.
SNIPPET_IMPORT_LINE, SNIPPET_REQUIRE = r"^(?:from|import)\s+\S+", r"require\s*\("
#: Patterns of test summaries and of failed builds.
SUMMARY_COUNT = r"\d+\s+(?:passed|failed|error)"
BUILD_ERRORS = [r"(?:syntax|compile|build)\s+error", r"cannot\s+find", r"undefined:", r"cannot\s+use", r"undeclared\s+name", r"expected\s+"]
CRASH_MARKS = [r"throw\s+\w+", r"Error:.*\n\s+at\s+"]
RED_TESTS = [r"(?i)=+\s+\d+\s+(?:failed|error)", r"\d+\s+failing", r"(?md)^FAIL\s+\S+"]
COLLECTION_ERRORS = [r"errors? during collection", r"collection error"]
#: What may stand before a command: assignments, env, timeout and set.
COMMAND_WRAPPERS = [r"(?:[A-Za-z_][A-Za-z0-9_]*=\S+\s+)+", r"env\s+", r"timeout\s+\S+\s+", r"set\s+-[A-Za-z]+(?:\s+-[A-Za-z]+)*\s*;\s*", r"set\s+-o\s+\S+\s*;\s*"]
#: Marks in observations by the failure mode that they stand for; the ladder that asks for them is in ``outcomes``.
MODE_MARKS = {
    "apply_patch_cmd_not_found": ["applypatch: command not found", "applypatch:command not found"],
    "apply_patch_other": ["no such file", "is a directory", "invalid patch", "patch failed", "could not find", "context does not match"],
    "strep_no_match": ["did not appear verbatim", "no replacement was performed", "no match", "did not match"],
    "strep_multiple_matches": ["multiple occurrences", "multiple matches", "matches the string to replace"],
    "strep_create_exists": ["file already exists"],
    "strep_invalid_range": ["invalid `view_range`", "invalid view_range"],
    "bash_history_expansion": ["event not found"],
    "bash_heredoc_unterminated": ["warning: here-document", "unexpected end of file"],
    "bash_syntax_error": ["syntax error near unexpected token"],
    "bash_command_not_found": ["command not found"],
    "py_module_not_found": ["modulenotfounderror", "no module named"],
}
#: Failure modes that come of a command's wrapping.
WRAPPER_MODES = [
    "apply_patch_cmd_not_found", "apply_patch_shell_syntax", "apply_patch_other", "bash_trailing_brace", "bash_quote_nesting",
    "bash_heredoc_unterminated", "bash_syntax_error", "bash_broken_pipe",
]
#: Sequence labels that are shown per run, and what inline code is for.
KEY_SEQUENCES = ["seq-verify-after-edit", "seq-edit-after-failed-verify", "seq-verify-rerun-no-edit", "seq-submit-after-verify"]
INLINE_INTENTS = ["run-inline-verify", "read-via-inline-script", "edit-via-inline-script", "create-file-via-inline-script", "check-version", "run-inline-snippet"]
#: Bands of letters, with and without git in a band of its own.
BANDS = {"understand": ["R", "S"], "reproduce": ["P"], "edit": ["E"], "verify": ["V"], "cleanup": ["G", "H"]}
SESSION_BANDS = {"understand": ["R", "S"], "reproduce": ["P"], "edit": ["E"], "verify": ["V"], "git": ["G"], "housekeeping": ["H"]}
#: Classes of user messages.
MESSAGE_CLASSES = ["task_brief", "authorize_work", "solution_steer", "evidence_or_repro", "qa_or_critique", "validation_request", "workflow_closeout"]

INTENT_CATEGORY = {intent: category for category, intents in CATEGORY_INTENTS.items() for intent in intents}
SESSION_CATEGORY = INTENT_CATEGORY | {intent: category for category, intents in SESSION_INTENTS.items() for intent in intents}
CATEGORY_PHASE = {category: phase for phase, categories in PHASES.items() for category in categories}
MODE_FAMILY = {mode: family for family, modes in FAILURES.items() for mode in modes}


def taxonomy(session: bool = False) -> list[tuple[str, str, str, str | None]]:
    """(intent, category, letter, phase)"""
    return [(i, c, LETTERS[c], CATEGORY_PHASE.get(c)) for i, c in sorted((SESSION_CATEGORY if session else INTENT_CATEGORY).items())]


def values_sql(rows: list[tuple]) -> str:
    """A VALUES list."""

    def one(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return "values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
