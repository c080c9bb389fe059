"""Fixed values.

Every string and number here decides what a result looks like (a file name, a
message, a pattern, a threshold), so each must keep exactly this value for
results to stay comparable.  They are stated once, here, as plain text.
"""

# Which files count, and what makes a directory a virtual environment.
PYTHON_SUFFIX = ".py"
ENV_CONFIG = "pyvenv.cfg"
ENV_INTERPRETERS = ("bin/python", "Scripts/python.exe")

# Score filter: a unit is kept when its maintainability is below this.
MAINTAINABILITY_THRESHOLD = 65.0

# Tokens that a prompt template may hold.
CODE_TOKEN = "{{CODE}}"
DOCS_TOKEN = "{{DOCS}}"

# What a method candidate shows in place of CODE_TOKEN.
METHOD_TARGET_FORMAT = (
    "\n\n{class_code}\n\n**FUZZING FOCUS**\nMethod Name: {method}\nMethod Body:\n{code}"
)

# The two documents of a docs block, in the order in which they are joined,
# and the banner around each of them.
DOC_KEYS = ("readme", "hooking")
DOC_TITLES = ("ATHERIS DOCUMENTATION", "ATHERIS' HOOKING DOCUMENTATION")
DOC_INTRO = (
    "This is the official README documentation for Google's Atheris fuzzing framework for Python."
)
BANNER_FORMAT = (
    "\n==== START OF {title} ====\n\n{intro}\n\n{body}\n\n==== END OF {title} ====\n"
)

# Characters of CPython's Unicode-aware ``\w`` (without ``_``) and ``\s``,
# spelled so that java.util.regex and RE2 read them the same way.
WORD_CLASS = r"\p{L}\p{N}"
SPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Fenced code blocks of an answer; group 1 is the code.
FENCE_PATTERN = "```[" + WORD_CLASS + "_+-]*[" + SPACE_CLASS + "]*\\n([\\s\\S]*?)```"
BLOCK_SEPARATOR = "\n\n"

# Markdown cleaning, applied in this order: (pattern, replacement).
MARKDOWN_STEPS = (
    (r"!\[[^\n]*?\]\([^\n]*?\)", ""),
    (r"\[[^\n]*?\]\(https?://[^\n]*?\)", ""),
    (r"\n{3,}", "\n\n"),
)

# Names of a run, of a harness and of its folder.
RUN_LABEL_FORMAT = "fuzzing({source})using({model}on({time})"
RUN_TIME_FORMAT = "MM-dd-yy_hh-mm-ssa"
HARNESS_FILE_FORMAT = "atheris_harness_for_(({name})).py"

# Failure report.
CONTEXT_GENERATION = "Generation"
CONTEXT_ORCHESTRATION = "Orchestration"
CONTEXT_PARSER = "Parser"
CONTEXT_THREADING = "Threading"
MESSAGE_NO_BLOCK = "No code block found in LLM response for: {name}"
MESSAGE_EMPTY = "Empty response from LLM for candidate: {name}"
MESSAGE_UNEXPECTED = "Unexpected error processing {name}: {error}"
MESSAGE_FUNCTIONS = "Critical error during function retrieval: {error}"
MESSAGE_CLASSES = "Critical error during class retrieval: {error}"
MESSAGE_THREAD = "Thread execution failed for {name}: {error}"
MESSAGE_FATAL = "Fatal coordination error: {error}"
FAILURE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
FAILURE_ENTRY_FORMAT = "[{ts}] [{context}]\n{message}\n" + "-" * 40 + "\n"

# Asked of the model client for every call.
CLIENT_RETRIES = 5
