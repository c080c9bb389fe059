"""Every fixed value against its plain literal, so that none changes unseen."""

from sourcemine import fixed_values as fixed

SPACES = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

LITERALS = {
    "PYTHON_SUFFIX": ".py",
    "ENV_CONFIG": "pyvenv.cfg",
    "ENV_INTERPRETERS": ("bin/python", "Scripts/python.exe"),
    "MAINTAINABILITY_THRESHOLD": 65.0,
    "CODE_TOKEN": "{{CODE}}",
    "DOCS_TOKEN": "{{DOCS}}",
    "METHOD_TARGET_FORMAT": "\n\n{class_code}\n\n**FUZZING FOCUS**\nMethod Name: {method}\nMethod Body:\n{code}",
    "DOC_KEYS": ("readme", "hooking"),
    "DOC_TITLES": ("ATHERIS DOCUMENTATION", "ATHERIS' HOOKING DOCUMENTATION"),
    "DOC_INTRO": "This is the official README documentation for Google's Atheris fuzzing framework for Python.",
    "BANNER_FORMAT": "\n==== START OF {title} ====\n\n{intro}\n\n{body}\n\n==== END OF {title} ====\n",
    "WORD_CLASS": r"\p{L}\p{N}",
    "SPACE_CLASS": SPACES,
    "FENCE_PATTERN": r"```[\p{L}\p{N}_+-]*[" + SPACES + r"]*\n([\s\S]*?)```",
    "BLOCK_SEPARATOR": "\n\n",
    "MARKDOWN_STEPS": (
        (r"!\[[^\n]*?\]\([^\n]*?\)", ""),
        (r"\[[^\n]*?\]\(https?://[^\n]*?\)", ""),
        (r"\n{3,}", "\n\n"),
    ),
    "RUN_LABEL_FORMAT": "fuzzing({source})using({model}on({time})",
    "RUN_TIME_FORMAT": "MM-dd-yy_hh-mm-ssa",
    "HARNESS_FILE_FORMAT": "atheris_harness_for_(({name})).py",
    "CONTEXT_GENERATION": "Generation",
    "CONTEXT_ORCHESTRATION": "Orchestration",
    "MESSAGE_NO_BLOCK": "No code block found in LLM response for: {name}",
    "MESSAGE_EMPTY": "Empty response from LLM for candidate: {name}",
    "MESSAGE_UNEXPECTED": "Unexpected error processing {name}: {error}",
    "CONTEXT_PARSER": "Parser",
    "CONTEXT_THREADING": "Threading",
    "MESSAGE_FUNCTIONS": "Critical error during function retrieval: {error}",
    "MESSAGE_CLASSES": "Critical error during class retrieval: {error}",
    "MESSAGE_THREAD": "Thread execution failed for {name}: {error}",
    "MESSAGE_FATAL": "Fatal coordination error: {error}",
    "FAILURE_TIME_FORMAT": "yyyy-MM-dd HH:mm:ss",
    "FAILURE_ENTRY_FORMAT": "[{ts}] [{context}]\n{message}\n----------------------------------------\n",
    "CLIENT_RETRIES": 5,
}


def test_every_fixed_value():
    found = {name: value for name, value in vars(fixed).items() if name.isupper()}
    assert found == LITERALS
