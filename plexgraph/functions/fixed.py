"""Names, patterns and words that decide which nodes, edges and marks a graph has.

They are part of the data model, not of this engine: a graph built here has to equal one built elsewhere from the same sources,
so these values must be the same everywhere. They stand here in plain text, and only here.
"""

from __future__ import annotations

# Constructors, and names that Ruby's interpreter calls by itself.
CONSTRUCTORS = ["__init__", "__new__", "constructor"]
RUBY_HOOKS = [
    "method_missing", "respond_to_missing?", "const_missing", "method_added", "singleton_method_added",
    "inherited", "included", "extended", "prepended", "coerce",
]

# Class-level macros of Ruby whose arguments name methods that are called later.
RUBY_MACROS = [
    "attr_accessor", "attr_reader", "attr_writer",
    "before_action", "after_action", "around_action",
    "before_filter", "after_filter", "around_filter",
    "before_save", "after_save", "around_save",
    "before_create", "after_create", "around_create",
    "before_update", "after_update", "around_update",
    "before_destroy", "after_destroy", "around_destroy",
    "before_validation", "after_validation",
    "after_commit", "after_rollback", "after_initialize", "after_find", "after_touch",
]

# Folders of tests.
TEST_FOLDERS = ["test", "tests", "spec", "__tests__", "__mocks__", "__fixtures__"]

# Decorators that hand a function to a framework, dotted ones that don't, and marks of stubs.
FRAMEWORK_DECORATORS = [
    "task", "shared_task", "periodic_task", "job", "receiver", "on_event", "handler",
    "validator", "field_validator", "root_validator", "model_validator", "contextmanager", "asynccontextmanager",
    "fixture", "route", "endpoint", "command", "hybrid_property",
]
PLAIN_DOTTED_DECORATORS = ["functools.wraps", "functools.lru_cache", "functools.cached_property", "functools.cache"]
STUB_DECORATORS = ["overload", "typing.overload", "abstractmethod", "abc.abstractmethod"]
ROUTE_DECORATORS = ["@app.route", "@router", "@click.command"]

# Base classes whose members are used by name, or whose subclasses a framework makes.
ENUMS = ["Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"]
MODEL_BASES = [
    "BaseModel", "BaseSettings", "Model", "Manager", "Base", "DeclarativeBase", "BaseEntity", "TestCase",
    "ApplicationRecord", "ApplicationController", "ApplicationJob", "ApplicationMailer", "ActiveRecord", "ActionController",
]

# Functions that bundlers and renderers look up by name, and the files where they do.
CONFIG_HOOKS = [
    "configure", "getLoadContext", "beforeAll", "onError", "onShellError", "onShellReady", "onAllReady",
    "esbuildOptions", "onSuccess", "viteFinal", "onwarn",
]
BUNDLER_HOOKS = [
    "resolveId", "load", "transform", "buildStart", "buildEnd", "closeBundle", "configResolved", "configureServer",
    "handleHotUpdate", "renderChunk", "generateBundle", "writeBundle", "options", "manualChunks", "renderStart", "renderError",
    "footer", "banner", "intro", "outro", "moduleParsed",
]
BUNDLER_FILES = ["vite.config", "vitest.config", "tsup.config", "rollup.config"]
RENDERER_FILES = ["entry.server.tsx", "entry.server.ts", "entry.server.js", "entry.client.tsx", "entry.client.ts", "entry.client.js"]

# Names and files where execution starts.
ENTRY_NAMES = ["main", "cli", "run", "app", "handler", "entrypoint"]
ENTRY_FILES = ["__main__.py", "cli.py", "main.py", "app.py"]

# Names of the languages' own functions and of usual libraries; a call of one gives no edge.
BUILTINS = {
    # Python
    "print", "len", "range", "map", "filter", "sorted", "list", "dict", "set", "str", "int", "float", "bool", "type", "super",
    "isinstance", "issubclass", "hasattr", "getattr", "setattr", "open", "iter", "next", "zip", "enumerate", "any", "all", "min",
    "max", "sum", "abs", "round", "repr", "id", "hash", "dir", "vars", "input", "format", "tuple", "frozenset", "bytes",
    "bytearray", "memoryview", "object", "property", "classmethod", "staticmethod", "delattr", "callable", "compile", "eval",
    "exec", "globals", "locals", "breakpoint", "exit", "quit",
    # methods of Python's containers, strings and files
    "append", "extend", "update", "pop", "get", "items", "keys", "values", "split", "join", "strip", "replace", "startswith",
    "endswith", "lower", "upper", "encode", "decode", "read", "write", "close",
    # JavaScript, its hosts and their objects' functions
    "console", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "JSON", "Array", "Object", "Promise", "Math", "Date",
    "Error", "Symbol", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURIComponent", "decodeURIComponent", "fetch",
    "require", "exports", "module", "document", "window", "process", "Buffer", "URL",
    "log", "error", "warn", "info", "debug", "parse", "stringify", "assign", "freeze", "isArray", "from", "of", "resolve",
    "reject", "race", "floor", "ceil", "random",
    # React
    "useState", "useEffect", "useRef", "useCallback", "useMemo", "useContext", "useReducer", "useLayoutEffect",
    "useImperativeHandle", "useDebugValue", "useId", "useTransition", "useDeferredValue",
}
RUBY_BUILTINS = {
    "puts", "p", "pp", "require_relative", "autoload", "load", "attr_accessor", "attr_reader", "attr_writer", "include", "prepend",
    "raise", "fail", "throw", "catch", "loop", "lambda", "proc", "send", "public_send", "respond_to?", "instance_variable_get",
    "instance_variable_set", "define_method", "method_missing", "new", "dup", "clone", "to_s", "to_sym", "to_a", "to_h", "to_i",
    "to_f", "each", "each_with_index", "each_with_object", "select", "reject", "reduce", "inject", "find", "detect", "collect",
    "flat_map", "sort", "sort_by", "group_by", "count", "first", "last", "push", "concat", "fetch", "merge", "key?", "nil?",
    "empty?", "blank?", "present?", "freeze!", "tap", "then", "yield_self",
}
GO_BUILTINS = {
    "append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print",
    "println", "real", "recover",
}

# Words of the graph query language: clauses that may begin a query, words that change something, procedures that only read.
FIRST_CLAUSES = ["match", "optional match", "return", "with", "unwind", "call"]
CHANGING_WORDS = [
    "delete", "drop", "create", "set", "remove", "merge", "detach", "install", "load", "copy", "alter", "export", "import",
    "attach", "begin", "commit", "rollback", "checkpoint", "use",
]
READING_PROCEDURES = ["query_fts_index", "show_tables", "table_info", "show_connection", "current_setting", "db_version"]

# Shapes of names in questions: quoted, PascalCase, camelCase, snake_case; and of source files.
NAME_SHAPES = [
    r"[`'\"]([A-Za-z_]\w*(?:\.\w+)*)[`'\"]",
    r"\b([A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)\b",
    r"\b([a-z]+(?:[A-Z][a-z0-9]*)+)\b",
    r"\b([a-z_][a-z0-9]*(?:_[a-z0-9]+)+)\b",
]
SOURCE_ENDINGS = ["py", "ts", "js", "tsx", "jsx"]
