"""Languages by file name: fixed values."""

# File extensions by language.
EXTENSIONS = {
    "python": ".py .pyw .pyi",
    "javascript": ".js .jsx .mjs .cjs",
    "typescript": ".ts .mts .cts",
    "tsx": ".tsx",
    "java": ".java .groovy",
    "kotlin": ".kt .kts",
    "scala": ".scala .sc",
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp .hh .hxx",
    "c_sharp": ".cs",
    "objc": ".m .mm",
    "go": ".go",
    "rust": ".rs",
    "php": ".php .php3 .php4 .php5 .phtml",
    "ruby": ".rb .rake .gemspec",
    "elixir": ".ex .exs",
    "erlang": ".erl .hrl",
    "haskell": ".hs .lhs",
    "ocaml": ".ml .mli",
    "elm": ".elm",
    "commonlisp": ".clj .cljs .cljc .lisp .lsp",
    "elisp": ".el",
    "julia": ".jl",
    "bash": ".sh .bash .zsh",
    "perl": ".pl .pm",
    "lua": ".lua",
    "r": ".r",
    "sql": ".sql .ddl .dml",
    "html": ".html .htm .xml",
    "css": ".css .scss .sass",
    "json": ".json .json5",
    "yaml": ".yaml .yml",
    "toml": ".toml",
    "markdown": ".md .markdown",
    "dockerfile": ".dockerfile",
    "hcl": ".tf .hcl",
    "make": ".mk",
    "fortran": ".f .f90 .f95",
}

# Whole file names that decide the language.
FILE_NAMES = {
    "dockerfile": "Dockerfile",
    "make": "Makefile makefile CMakeLists.txt",
    "ruby": "Gemfile Rakefile",
    "gomod": "go.mod",
    "text": "requirements.txt .env",
}

# Languages analysed in depth.
DEEP = ("python", "javascript", "typescript", "tsx", "java", "go", "php", "c_sharp", "ruby")

# Labels that differ from the capitalised language.
LABELS = {
    "javascript": "JavaScript", "typescript": "TypeScript", "tsx": "TypeScript (TSX)", "cpp": "C++", "c_sharp": "C#",
    "objc": "Objective-C", "php": "PHP", "ocaml": "OCaml", "commonlisp": "Lisp", "elisp": "Emacs Lisp", "bash": "Shell",
    "sql": "SQL", "html": "HTML", "css": "CSS", "json": "JSON", "yaml": "YAML", "toml": "TOML", "hcl": "HCL/Terraform",
    "gomod": "Go Modules",
}

# Directories that are never entered.
SKIPPED_DIRS = (
    ".git .hg .svn __pycache__ node_modules vendor venv .venv env .env.d dist build out target .idea .vscode .gradle .mvn "
    "bin obj coverage .pytest_cache .mypy_cache .tox bower_components jspm_packages .next .nuxt .cache migrations"
).split()

# Endings of files that hold no source.
BINARY_ENDINGS = (
    ".png .jpg .jpeg .gif .bmp .ico .svg .webp .pdf .zip .tar .gz .bz2 .7z .rar .jar .war .exe .dll .so .dylib .o .a .class "
    ".pyc .pyo .mp3 .mp4 .avi .mov .wav .ttf .otf .woff .woff2 .eot .db .sqlite .sqlite3 .lock .min.js .min.css .map .bin "
    ".dat .pickle .pkl .npy .parquet"
).split()

MAX_FILE_BYTES = 1_500_000


def by_extension() -> dict[str, str]:
    return {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()}


def by_file_name() -> dict[str, str]:
    return {name: lang for lang, names in FILE_NAMES.items() for name in names.split()}


def labels() -> dict[str, str]:
    return {lang: LABELS.get(lang, lang.capitalize()) for lang in [*EXTENSIONS, "gomod"]}
