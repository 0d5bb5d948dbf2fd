"""Classifiers of session transcripts: tool calls, user messages, models, issue links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import CONFIG_FILES
from .intents import TEST_FILE, script_intent, snippet_intent, with_intent
from .text import basename, bind, first_line, git_subcommand, has, ladder, once, script_name, starts, strip, strip_wrappers, text, unwrap_command

ISSUE_URL = r"https://github\.com/[^\s\)\]]+/(issues|pull|pulls)/(\d+)"
#: Git subcommands of each session intent.
GIT_GROUPS = {
    "git-diff-review": ["diff"],
    "git-publish": ["push"],
    "git-sync-integrate": ["fetch", "pull", "rebase", "merge", "cherry-pick", "am"],
    "git-local-state-change": ["add", "commit", "stash", "reset", "checkout", "switch", "restore", "apply", "rm", "mv", "clean"],
    "git-repo-inspect": ["status", "show", "log", "branch", "tag", "worktree", "remote", "rev-parse", "describe", "config", "ls-files", "blame", "submodule"],
}
#: Checks that count as building.
CHECKS = (
    "npm run check", "pnpm check", "yarn check", "biome check", "eslint ", "tsc --noemit", "tsgo --noemit", "npm run lint", "pnpm lint", "yarn lint", "npm run generate-models",
)
WRAPPER_LINE = r"^(?:set\s+-[a-zA-Zuoepx\s-]+|[A-Za-z_][A-Za-z0-9_]*=.*|then|fi|do|done)$"


def normalize_model(name: Column) -> Column:
    """Without vendor prefixes, with hyphens in versions of two families; null and empty are 'unknown'."""
    bare = F.regexp_replace(strip(text(name)), r"^global\.anthropic\.", "")
    bare = F.regexp_replace(bare, r"^us\.anthropic\.", "")
    fixed = F.regexp_replace(bare, r"claude-(opus|sonnet)-4\.([56])", "claude-$1-4-$2")
    return F.when(text(name) == "", "unknown").otherwise(fixed)


def meaningful_command(command: Column) -> Column:
    """A shell command without blank lines, lines of mere set-up, and a lone leading cd."""

    def of_lines(bare: Column, kept: Column) -> Column:
        first = text(F.get(kept, F.lit(0)))
        led = (F.size(kept) > 1) & first.startswith("cd ") & ~first.contains("&&")
        return strip(F.when(F.size(kept) == 0, bare).when(led, F.array_join(F.slice(kept, 2, 2**20), "\n")).otherwise(F.array_join(kept, "\n")))

    lines = lambda bare: F.transform(F.split(bare, "\r?\n"), strip)
    kept = lambda bare: F.filter(lines(bare), lambda x: (x != "") & ~x.rlike(WRAPPER_LINE))
    return bind(strip_wrappers(unwrap_command(command)), lambda bare: bind(kept(bare), lambda k: of_lines(bare, k)))


def with_tool_intent(calls: DataFrame, out: str = "intent", action: str | None = None) -> DataFrame:
    """Intent of calls(name, path, command, pattern, has_range, old_text, is_error, result); nulls count as empty.

    ``action`` names a column for the shell command that a call stands for, if it does.
    """
    shell_action = action
    name, path, result, bad = text(F.col("name")), text(F.col("path")), text(F.col("result")), F.coalesce("is_error", F.lit(False))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    shell = (
        F.when(name == "bash", text(F.col("command")))
        .when(name == "ls", F.concat(F.lit("ls "), F.when(path == "", ".").otherwise(path)))
        .when(name == "find", F.concat(F.lit("find "), F.when(path == "", ".").otherwise(path), F.lit(" -name "), quoted(F.coalesce(F.nullif("pattern", F.lit("")), F.lit("**/*")))))
        .when(name == "grep", F.concat(F.lit("rg -n "), quoted(text(F.col("pattern"))), F.lit(" "), quoted(F.when(path == "", ".").otherwise(path))))
        .when(name == "finish_and_exit", "submit")
        .when(name.isin("hello", "greet"), "echo hello")
        .otherwise("")
    )
    staged = calls.withColumn("_action", meaningful_command(shell)).withColumn("_shell", shell).withColumn("_seen", result)
    staged = with_intent(staged, "_action", "_seen", "_base")
    staged = staged.withColumn("_top", strip(first_line(F.lower("_action")))).withColumn("_name", F.lower(basename(path)))
    file, head, action = F.col("_name"), F.col("_top"), F.col("_action")
    testlike = has(file, "test_", "repro", "verify", "check", ".test.", ".spec.")
    read = ladder(
        [
            (bad, "read-file-failed"),
            (F.coalesce("has_range", F.lit(False)), "read-file-range"),
            (file.rlike(TEST_FILE), "read-test-file"),
            (file.isin(*CONFIG_FILES, "dockerfile", ".env", ".gitignore"), "read-config-file"),
            (has(F.lower(result), "too large", "truncated"), "read-file-full(truncated)"),
        ],
        "read-file-full",
    )
    write = ladder(
        [
            (has(file, "repro", "reproduce", "demo"), "create-repro-script"),
            (has(file, "test_", "test.py", "test.js", "test.go", ".test.", ".spec."), "create-test-script"),
            (has(file, "verify", "check", "validate", "edge_case"), "create-verify-script"),
            (has(file, "summary", "readme", "changes", "implementation", "notes", "design"), "create-documentation"),
        ],
        "create-file",
    )
    edit = ladder(
        [
            (bad & testlike, "edit-test-or-repro(failed)"),
            (bad, "edit-source(failed)"),
            (F.col("old_text") == "", "insert-source"),
            (testlike, "edit-test-or-repro"),
        ],
        "edit-source",
    )
    sub = git_subcommand(action)
    snippet = F.regexp_extract(action, r"\s(?:--eval|-e)\s([\s\S]*)$", 1)
    shells = ladder(
        [
            (action.rlike(r"(?:^|\s|/)pi-skills/brave-search/search\.js\b"), "web-search"),
            (head.rlike(r"^tmux\b"), "tmux-session"),
            (head.rlike(r"^curl\b"), "fetch-url"),
            (starts(head, "gh "), "git-github-context"),
            *((sub.isin(*names), intent) for intent, names in GIT_GROUPS.items()),
            (has(head, *CHECKS), "compile-build"),
            (has(head, "vitest", "jest", "mocha", "ava ", "tap ") & has(head, " --run ", " test/", ".test.", ".spec.", " -t ", " --grep "), "run-test-specific"),
            (has(head, "vitest", "jest", "mocha", "ava ", "tap "), "run-test-suite"),
            (head.rlike(r"\b(?:npx\s+)?tsx\b") & (snippet != ""), snippet_intent(snippet)),
            (head.rlike(r"\b(?:npx\s+)?tsx\b"), script_intent(script_name(action))),
            (has(head, "docker run", "docker build", "docker exec", "podman run"), "compile-build"),
            (has(head, "mktemp", "tmpdir=$(", "pid=$(cat "), "file-cleanup"),
            (starts(head, "npm ls", "pnpm ls", "yarn list"), "install-deps"),
            ((F.col("_base") == "bash-other") & bad, "bash-command(failed)"),
        ],
        F.col("_base"),
    )
    return staged.withColumn(
        out,
        once(ladder(
            [
                (name == "read", read),
                (name == "write", write),
                (name == "edit", edit),
                (name.isin("todo", "watch_plans_start"), "bash-other"),
                (name == "", "empty"),
                (F.col("_shell") != "", shells),
                (bad, "bash-command(failed)"),
            ],
            "bash-other",
        )),
    ).withColumn(shell_action or "_none", F.col("_action")).drop("_action", "_shell", "_seen", "_base", "_top", "_name", "_none")


#: What user messages of each class say.
TASK_BRIEF = r"(?i)^(?:analyze github issue\(s\):|\"?/is https://github\.com/.+/issues/\d+)|for each issue:|read the issue in full|do not implement unless explicitly asked"
WORKFLOW = (
    r"(?i)\b(?:commit and push|commit an dpush|commit with(?: closes| #closes)?(?:, push)?|commit the files|ready to commit|close issue|close the issue|"
    r"leave a comment(?: on the issue)?|in my tone|add a changelog entry|changelog entry|CHANGELOG\.md|changelog|docs? in @|docs? are in @|docs? up-to-date|merge(?: into main| to main|"
    r" via gh cli)?|wrap it|just update docs)\b|^commit\b|^push\b"
)
EVIDENCE = (
    r"(?i)^(?:➜|/var/folders/|/Users/|ffb647c$|https://agentskills\.io/|https://github\.com/)|screenshot\\|still ?get the crash|stillget the crash|seeing this|now i get this|git:\(|node packages/|pi-test\.sh|"
    r"failed to load extension|throw new Error|ERR_MODULE_NOT_FOUND|SyntaxError:|ENOENT:|the other folder is|different impl in|same file you modified in this clone"
)
VALIDATION = r"(?i)\b(?:test it|how can i test|run the test|run the specific test|execute it|try locall|can i test|what are the changes\?|looks good|lgtm|works fine|seems to work|test works\?|sleep for \d+ seconds)\b"
CRITIQUE = (
    r"(?i)terrible analysis|isn't that brittle|dude, what were your instructions|i did not ask you|you still don't understand|noo, we need a smarter way|why (?:this|would|did|in teh fuck)|what in the fuck|"
    r"where the fuck|don't care\.|don't care,|that seems like the simplest option|we established that|do i understand correctly|are you sure this doesn't|explain the test to me|what were your instructions"
)
AUTHORIZE = r"(?i)\b(?:implement|make the change|do it|fix it|fix this|go to town|apply the fix|continue|ok, fix|ok, please implement|ok, implement|can you just implement it properly)\b"
STEER = (
    r"(?i)\b(?:we need|we should|i think we should|can we|why not|no backward compatibility|only add|remove the|remove that file|what about|what baout|any reason|problem:|not ideal|"
    r"ok, then lets|ok, then let's|should be|must also|must be|should rename|should use|add a test|set up a minimal test|check if|use dynamic import|just use|just implement|"
    r"switch to that|kill that|all we need|that too|modify the|update the)\b|@packages/|<skill |baseUrl\.|model\.id\.includes|XHIGH_MODELS|ENV_AGENT_DIR|^const |^// |^\+\d+|"
    r"^f afterEach|^skills\?:|^declare module"
)
DETAILS = ("should", "instead", "@packages/", "model selector", "wraps the", "use ")
#: A user ends an issue.
CLOSE_INSTRUCTION = (
    r"(?i)\b(?:(?:close|closed)(?:\s+\S{1,6})?\s+(?:issue|duplicate|as\s+duplicate)|close it(?:\s+as\s+\S{1,12})?|comment and close|close and comment|post (?:that|this|a comment) (?:on|to|in) (?:the )?issue|"
    r"post (?:that|this) on the issue|comment on the issue|add a comment to the issue|leave a comment on (?:the )?issue|(?:mark|flag) (?:as |it as )?(?:duplicate|resolved|won'?t ?fix|wontfix|not a bug)|"
    r"won'?t ?fix|wontfix|by design|working as intended|not (?:our|my) (?:bug|problem|issue|responsibility|concern)|(?:i )?don'?t care|(?:it'?s |that'?s )?on (?:the )?user'?s?\s+(?:end|side|problem)|"
    r"(?:user|they) (?:has to|have to|need(?:s)? to) [^.]{1,80}(?:extension|sdk|their (?:code|end|side))|cannot reproduce|can'?t reproduce|not reproducible)\b"
)
#: A session ends in praise or in blame.
CLOSEOUT_WORDS = r"(?i)\b(?:commit|push|close (?:the )?issue|merge|ship|wrap it|add a? changelog|leave a comment|thanks,? (?:fixed|implemented)|looking good|lgtm|looks good|seems to work|jupp|works fine)\b"
BLAME_WORDS = (
    r"(?i)\b(?:brittle|terrible|shit|fuck|what were your instructions|you missed|you still don't understand|dude,? what|don't care|no,? we need|why (?:this|would|did)|did you actually|we established that|"
    r"are you sure this doesn't)\b"
)


def message_class(message: Column, index: Column) -> Column:
    """One of seven classes of a user message, from its text and its place among the session's user messages."""
    return bind(strip(F.regexp_replace(text(message), r"\s+", " ")), lambda s: _class(s, index))


def _class(s: Column, index: Column) -> Column:
    low, steering = F.lower(s), s.rlike(STEER)
    detailed = (steering | (F.length(s) > 220)) & has(low, *DETAILS)
    return ladder(
        [
            ((index == 1) & low.rlike(TASK_BRIEF), "task_brief"),
            (s.rlike(EVIDENCE), "evidence_or_repro"),
            (s.rlike(VALIDATION) & ~s.rlike(WORKFLOW), "validation_request"),
            (s.rlike(WORKFLOW), "workflow_closeout"),
            (s.rlike(CRITIQUE), "qa_or_critique"),
            (s.rlike(AUTHORIZE), F.when(detailed, "solution_steer").otherwise("authorize_work")),
            (steering, "solution_steer"),
            (index == 1, "task_brief"),
        ],
        "solution_steer",
    )


def issue_keys(name: Column, first_text: Column) -> Column:
    """Distinct issue numbers linked in a session's name or in the first 1,000 characters of its first user message."""
    both = F.concat(text(name), F.lit("\n"), F.substring(text(first_text), 1, 1000))
    return F.array_distinct(F.regexp_extract_all(both, F.lit(ISSUE_URL), F.lit(2)))
