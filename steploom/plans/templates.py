"""Step, message and tool-call templates with labels given by hand: the golden rows of the tests and of the SQL oracle."""

from __future__ import annotations

OK, TB = "", 'Traceback (most recent call last):\n  File "a.py", line 1, in <module>\n'
#: (action, observation, intent, verify outcome, failure mode or None, action category)
STEPS: list[tuple[str | None, str | None, str, str, str | None, str]] = [
    ("", "", "empty", "", None, "other"),
    (None, None, "empty", "", None, "other"),
    ("  \n ", "x", "empty", "", None, "other"),
    ("submit", "done", "submit", "", None, "submit"),
    ("Submit now", "", "submit", "", None, "other"),
    ("str_replace_editor view /r/src/app.py --view_range 1 20", "1 a", "read-file-range", "", None, "view"),
    ("str_replace_editor view /r/src", "Here are the files and directories up to 2 levels", "view-directory", "", None, "view"),
    ("str_replace_editor view /r/lib/", "x", "view-directory", "", None, "view"),
    ("str_replace_editor view /r/.hidden", "x", "view-directory", "", None, "view"),
    ("str_replace_editor view /r/tests/test_app.py", "x", "read-test-file", "", None, "view"),
    ("str_replace_editor view /r/pkg/app_test.go", "x", "read-test-file", "", None, "view"),
    ("str_replace_editor view /r/package.json", "{}", "read-config-file", "", None, "view"),
    ("str_replace_editor view '/r/my dir/big.py'", "File is too large to display entirely", "read-file-full(truncated)", "", None, "view"),
    ("str_replace_editor view /r/src/app.py", "def f(): pass", "read-file-full", "", None, "view"),
    ("str_replace_editor view /r/no.py", "The path /r/no.py does not exist. Please provide a valid path.", "read-file-full", "", "strep_file_not_found", "view"),
    ("str_replace_editor view /r/app.py --view_range 9 2", "Invalid `view_range`: [9, 2]", "read-file-range", "", "strep_invalid_range", "view"),
    ("str_replace_editor create /r/reproduce_bug.py --file_text 'x'", "File created", "create-repro-script", "", None, "create"),
    ("str_replace_editor create /r/test_new.py --file_text 'x'", "File created", "create-test-script", "", None, "create"),
    ("str_replace_editor create /r/verify_fix.js --file_text 'x'", "File created", "create-verify-script", "", None, "create"),
    ("str_replace_editor create /r/SUMMARY.md --file_text 'x'", "File created", "create-documentation", "", None, "create"),
    ("str_replace_editor create /r/src/new.py --file_text 'x'", "File already exists at: /r/src/new.py. Cannot overwrite", "create-file", "", "strep_create_exists", "create"),
    ("str_replace_editor str_replace /r/src/app.py --old_str 'a' --new_str 'b'", "The file has been edited", "edit-source", "", None, "edit"),
    ("str_replace_editor str_replace /r/tests/test_app.py --old_str 'a'", "edited", "edit-test-or-repro", "", None, "edit"),
    ("str_replace_editor str_replace /r/app.py --old_str 'a'", "No replacement was performed, old_str did not appear verbatim", "edit-source", "", "strep_no_match", "edit"),
    ("str_replace_editor str_replace /r/app.py --old_str 'b'", "Multiple occurrences of old_str", "edit-source", "", "strep_multiple_matches", "edit"),
    ("str_replace_editor insert /r/app.py 3 x", "edited", "insert-source", "", None, "edit"),
    ("str_replace_editor undo_edit /r/app.py", "Last edit undone", "undo-edit", "", None, "other"),
    ('bash -lc "grep -rn foo src"', "src/a.py:1:foo", "search-keyword", "", None, "search_find"),
    ('bash -lc "grep foo || true}"}', "bash: true}: command not found", "search-keyword(failed)", "", "bash_trailing_brace", "search_find"),
    ('bash -lc "echo "a" "b""', "a: command not found\nb: command not found", "bash-command(failed)", "", "bash_quote_nesting", "bash"),
    ("rg -n foo", "bash: rg: command not found", "search-keyword(failed)", "", "bash_command_not_found", "other"),
    ("python run.py <<'X'\n!keys", "bash: !keys: event not found", "run-custom-script", "", "bash_history_expansion", "bash"),
    ("cat <<'EOF' > a", "warning: here-document at line 3 delimited by end-of-file", "read-via-bash(failed)", "", "bash_heredoc_unterminated", "bash"),
    ("pytest -q (x", "bash: syntax error near unexpected token `('", "run-test-suite(failed)", "", "bash_syntax_error", "bash"),
    ("python a.py | head -1", "write error: Broken pipe", "run-script(failed)", "", "bash_broken_pipe", "bash"),
    ("applypatch <<'PATCH'\n*** Begin\nPATCH", "bash: applypatch: command not found", "bash-command(failed)", "", "apply_patch_cmd_not_found", "bash"),
    ("applypatch <<'PATCH'\n(x)\nPATCH", "bash: syntax error near unexpected token `('", "bash-command(failed)", "", "apply_patch_shell_syntax", "bash"),
    ("applypatch <<'PATCH'\nx\nPATCH", "patch failed: no such file", "apply-patch", "", "apply_patch_other", "bash"),
    ("applypatch <<'PATCH'\ny\nPATCH", "Done", "apply-patch", "", None, "bash"),
    ("cd /r && python -m pytest tests", "===== 5 passed in 0.08s =====", "run-test-suite", "pass", None, "bash"),
    ("cd /r && pytest tests", "===== 1 failed, 4 passed in 1.20s =====", "run-test-suite", "fail", "test_failed", "bash"),
    ("pytest tests/test_a.py::test_b", "2 passed in 0.10s", "run-test-specific", "pass", None, "bash"),
    ("pytest -k foo tests", "1 failed, 5 passed in 0.08s", "run-test-specific", "fail", None, "bash"),
    ("pytest bad", "=== 1 error during collection ===\nno tests ran in 0.01s", "run-test-suite", "fail", "test_collection_error", "bash"),
    ("pytest worse", "Interrupted: 2 errors during collection", "run-test-suite", "", "test_collection_error", "bash"),
    ("npm test", "  3 passing (10ms)", "run-test-suite", "pass", None, "bash"),
    ("npx mocha", "  3 passing\n  1 failing", "run-test-suite", "fail", "test_failed", "other"),
    ("go test ./...", "ok  \tpkg/a\t0.1s\nFAIL\tpkg/b\t0.2s", "run-test-suite", "fail", "test_failed", "bash"),
    ("go test ./b", "ok  \tpkg/b\t0.2s", "run-test-suite", "pass", None, "bash"),
    ("go test -v ./c", "--- PASS: TestA (0.00s)", "run-test-suite", "pass", None, "bash"),
    ("npx jest a", "Tests: 1 failed, 2 passed, 3 total", "run-test-suite", "fail", None, "other"),
    ("yarn test", "Tests:       3 passed, 3 total", "run-test-suite", "pass", None, "bash"),
    ("FOO=1 timeout 60 env pytest", "3 passed in 2.00s", "run-test-suite", "pass", None, "other"),
    ("set -e; python -m py_compile a.py", "\n", "syntax-check", "pass", None, "other"),
    ("python -m py_compile b.py", "SyntaxError: invalid syntax", "syntax-check", "fail", "py_syntax_error", "bash"),
    ("node -c a.js && echo ✓", "✓", "syntax-check", "pass", None, "bash"),
    ("go build ./...", "\n", "compile-build", "pass", None, "bash"),
    ("go vet ./...", "a.go:3: undefined: x", "compile-build", "fail", None, "bash"),
    ("make all", "panic: bad", "compile-build", "fail", None, "bash"),
    ("npx tsc --noEmit", "done", "compile-build", "", None, "other"),
    ("npm run build", "built\nexit status 2", "compile-build", "fail", None, "bash"),
    ("find . -name '*.py'", "./a.py", "search-files-by-name", "", None, "search_find"),
    ("find . -name '*.py' | xargs grep foo", "./a.py:foo", "search-files-by-content", "", None, "search_find"),
    ("sed -n 1,20p src/a.py", "x", "read-via-bash", "", None, "bash"),
    ("cat src/a.py", "x", "read-via-bash", "", None, "bash"),
    ("ls -la", "total 0", "list-directory", "", None, "bash"),
    ("python -c \"import app; assert app.f() == 1\"", "x", "run-inline-snippet", "", None, "bash"),
    ("python3 - <<'E'\nimport a\nprint(a.x)\nE", "1 passed, 0 failed", "run-inline-verify", "pass", None, "bash"),
    ("python - <<'E'\np=open('a').read()\nopen('a','w').write(p.replace('x','y'))\nE", "", "edit-via-inline-script", "", None, "bash"),
    ("python -c \"open('a', 'w')\"", "", "create-file-via-inline-script", "", None, "bash"),
    ("node -e \"fs.readFileSync('a')\"", "x", "read-via-inline-script", "", None, "bash"),
    ("node -c \"x\" y", "x", "syntax-check", "", None, "bash"),
    ("python -c \"sys.version\"", "3", "check-version", "", None, "bash"),
    ("python -c \"print(1)\"", TB + "TypeError: x", "run-inline-verify", "fail", "py_traceback_other", "bash"),
    ("python -c \"x = 1\"", "IndentationError: unexpected indent", "run-inline-snippet", "", "py_indentation_error", "bash"),
    ("python reproduce.py", TB + "ModuleNotFoundError: No module named 'x'", "run-repro-script", "", "py_module_not_found", "bash"),
    ("python verify_all.py", "3 passed, 1 failed", "run-verify-script", "fail", None, "bash"),
    ("python tools/gen.py", TB + "KeyError: 1", "run-custom-script", "fail", "py_traceback_other", "bash"),
    ("node demo.js", "node:internal/modules/cjs\n  throw err;", "run-repro-script", "", "node_error", "bash"),
    ("./check.sh --fast", "2 passed and 0 failed", "run-verify-script", "pass", None, "other"),
    ("bash run.sh", "ok", "run-custom-script", "", None, "bash"),
    ("git -C /r diff", "diff --git", "git-diff", "", None, "bash"),
    ("git log --oneline", "abc", "git-status-log", "", None, "bash"),
    ("git stash pop", "x", "git-stash", "", None, "bash"),
    ("git -C /r", "usage", "bash-other", "", None, "bash"),
    ("git commit -m 'x y'", "1 file", "bash-other", "", None, "bash"),
    ("rm -f /r/repro.py", "", "file-cleanup", "", None, "bash"),
    ("pip install -e .", "ok", "install-deps", "", None, "bash"),
    ("redis-server --daemonize yes", "", "start-service", "", None, "bash"),
    ("which node", "/usr/bin/node", "check-tool-exists", "", None, "bash"),
    ("wc -l a.py", "3 a.py", "inspect-file-metadata", "", None, "bash"),
    ("echo done", "done", "echo", "", None, "bash"),
    ("source venv/bin/activate && cd /r && ls", "a", "list-directory", "", None, "bash"),
    ("export A=1", "", "bash-other", "", None, "bash"),
    ("whoami", "root", "bash-other", "", None, "bash"),
]
#: (text, class as a first message, class as a later message)
MESSAGES: list[tuple[str, str, str]] = [
    ("Analyze GitHub issue(s): please", "task_brief", "solution_steer"),
    ("read the issue in full and report", "task_brief", "solution_steer"),
    ("implement", "authorize_work", "authorize_work"),
    ("ok, do it", "authorize_work", "authorize_work"),
    ("implement it but it should use the registry, we need one place", "solution_steer", "solution_steer"),
    ("we should rename that helper", "solution_steer", "solution_steer"),
    ("/Users/me/x: seeing this", "evidence_or_repro", "evidence_or_repro"),
    ("now i get this again", "evidence_or_repro", "evidence_or_repro"),
    ("isn't that brittle", "qa_or_critique", "qa_or_critique"),
    ("we established that already", "qa_or_critique", "qa_or_critique"),
    ("how can i test this", "validation_request", "validation_request"),
    ("lgtm", "validation_request", "validation_request"),
    ("commit and push", "workflow_closeout", "workflow_closeout"),
    ("lgtm, add a changelog entry", "workflow_closeout", "workflow_closeout"),
    ("hmm", "task_brief", "solution_steer"),
]
#: (name, path, command, pattern, has_range, old_text, is_error, result, intent, pushed)
TOOLS: list[tuple] = [
    ("read", "/r/a.ts", None, None, False, None, False, "x", "read-file-full", False),
    ("read", "/r/a.ts", None, None, True, None, False, "x", "read-file-range", False),
    ("read", "/r/test_a.py", None, None, False, None, False, "x", "read-test-file", False),
    ("read", "/r/Dockerfile", None, None, False, None, False, "x", "read-config-file", False),
    ("read", "/r/b.ts", None, None, False, None, False, "output truncated", "read-file-full(truncated)", False),
    ("read", "/r/no.ts", None, None, False, None, True, "ENOENT", "read-file-failed", False),
    ("write", "/r/demo.ts", None, None, False, None, False, "ok", "create-repro-script", False),
    ("write", "/r/a.test.ts", None, None, False, None, False, "ok", "create-test-script", False),
    ("write", "/r/check.ts", None, None, False, None, False, "ok", "create-verify-script", False),
    ("write", "/r/notes.md", None, None, False, None, False, "ok", "create-documentation", False),
    ("write", "/r/new.ts", None, None, False, None, False, "ok", "create-file", False),
    ("edit", "/r/a.ts", None, None, False, "x", False, "ok", "edit-source", False),
    ("edit", "/r/a.ts", None, None, False, "", False, "ok", "insert-source", False),
    ("edit", "/r/a.spec.ts", None, None, False, "x", False, "ok", "edit-test-or-repro", False),
    ("edit", "/r/a.ts", None, None, False, "x", True, "no", "edit-source(failed)", False),
    ("edit", "/r/verify.ts", None, None, False, "x", True, "no", "edit-test-or-repro(failed)", False),
    ("todo", None, None, None, False, None, False, "ok", "bash-other", False),
    ("", None, None, None, False, None, False, "", "empty", False),
    ("ls", "/r", None, None, False, None, False, "a", "list-directory", False),
    ("find", "/r", None, "*.ts", False, None, False, "a", "search-files-by-name", False),
    ("grep", "/r", None, "foo", False, None, False, "a", "search-keyword", False),
    ("finish_and_exit", None, None, None, False, None, False, "", "submit", False),
    ("mystery", None, None, None, False, None, True, "no", "bash-command(failed)", False),
    ("mystery", None, None, None, False, None, False, "ok", "bash-other", False),
    ("bash", None, "cd /r\nnpm run check", None, False, None, False, "ok", "compile-build", False),
    ("bash", None, "npx vitest --run test/a.test.ts", None, False, None, False, "3 passed", "run-test-specific", False),
    ("bash", None, "npx vitest", None, False, None, False, "3 passed", "run-test-suite", False),
    ("bash", None, "tmux new -d", None, False, None, False, "", "tmux-session", False),
    ("bash", None, "curl http://x", None, False, None, False, "x", "fetch-url", False),
    ("bash", None, "gh issue view 3", None, False, None, False, "x", "git-github-context", False),
    ("bash", None, "git status", None, False, None, False, "x", "git-repo-inspect", False),
    ("bash", None, "git diff", None, False, None, False, "x", "git-diff-review", False),
    ("bash", None, "git pull --rebase", None, False, None, False, "x", "git-sync-integrate", False),
    ("bash", None, "git add -A", None, False, None, False, "x", "git-local-state-change", False),
    ("bash", None, "git push origin main", None, False, None, False, "main -> main", "git-publish", True),
    ("bash", None, "git push", None, False, None, False, "! [rejected] main", "git-publish", False),
    ("bash", None, "node /s/pi-skills/brave-search/search.js q", None, False, None, False, "x", "web-search", False),
    ("bash", None, "docker run x", None, False, None, False, "x", "compile-build", False),
    ("bash", None, "mktemp -d", None, False, None, False, "x", "file-cleanup", False),
    ("bash", None, "npm ls", None, False, None, False, "x", "install-deps", False),
    ("bash", None, "frobnicate", None, False, None, True, "no", "bash-command(failed)", False),
    ("bash", None, "gh issue close 3", None, False, None, False, "closed", "git-github-context", False),
    ("bash", None, "gh pr merge 4", None, False, None, False, "merged", "git-github-context", False),
    ("bash", None, "gh issue comment 5 -b fixed", None, False, None, False, "ok", "git-github-context", False),
    ("bash", None, "git commit -m x", None, False, None, False, "1 file", "git-local-state-change", False),
    ("bash", None, "npx tsx demo.ts", None, False, None, False, "x", "run-repro-script", False),
]
#: Intents of the calls that differ when a call has no result, by (name, path, command, is_error).
NO_RESULT = {
    ("read", "/r/b.ts", None, False): "read-file-full",
    ("read", "/r/no.ts", None, True): "read-file-full",
    ("edit", "/r/a.ts", None, True): "edit-source",
    ("edit", "/r/verify.ts", None, True): "edit-test-or-repro",
    ("mystery", None, None, True): "bash-other",
    ("bash", None, "frobnicate", True): "bash-other",
}
#: Command signatures of step templates whose first line isn't their bare command, by action.
SIGNATURES = {
    "  \n ": "",
    'bash -lc "grep -rn foo src"': "grep -rn foo src",
    'bash -lc "grep foo || true}"}': "grep foo || true}",
    'bash -lc "echo "a" "b""': 'echo "a" "b"',
    "cd /r && python -m pytest tests": "python -m pytest tests",
    "cd /r && pytest tests": "pytest tests",
    "FOO=1 timeout 60 env pytest": "pytest",
    "set -e; python -m py_compile a.py": "python -m py_compile a.py",
    "source venv/bin/activate && cd /r && ls": "ls",
}
#: Git subcommands of step templates, by action.
GIT = {"git -C /r diff": "diff", "git log --oneline": "log", "git stash pop": "stash", "git commit -m 'x y'": "commit"}
