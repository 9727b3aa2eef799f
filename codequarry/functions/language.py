"""Language of a path, from its base name alone."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .paths import basename, extension

# Language names by lower-case extension.
EXTENSION_LANGUAGE = {
    ".py": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".java": "Java",
    ".c": "C", ".h": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".hxx": "C++",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".kt": "Kotlin", ".kts": "Kotlin",
    ".scala": "Scala",
    ".m": "Objective-C", ".mm": "Objective-C",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell",
    ".ps1": "PowerShell",
    ".sql": "SQL",
    ".html": "HTML", ".htm": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "SASS",
    ".less": "Less",
    ".vue": "Vue",
    ".svelte": "Svelte",
    ".astro": "Astro",
    ".md": "Markdown", ".markdown": "Markdown",
    ".rst": "reStructuredText",
    ".json": "JSON", ".jsonc": "JSON",
    ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML",
    ".xml": "XML",
    ".ini": "INI", ".cfg": "INI",
    ".dockerfile": "Dockerfile",
    ".lua": "Lua",
    ".pl": "Perl", ".pm": "Perl",
    ".r": "R",
    ".dart": "Dart",
    ".ex": "Elixir", ".exs": "Elixir",
    ".erl": "Erlang", ".hrl": "Erlang",
    ".clj": "Clojure",
    ".cljs": "ClojureScript",
    ".hs": "Haskell", ".lhs": "Haskell",
    ".ml": "OCaml", ".mli": "OCaml",
    ".fs": "F#", ".fsx": "F#",
    ".groovy": "Groovy",
    ".gradle": "Gradle",
    ".vb": "Visual Basic",
    ".vbs": "VBScript",
    ".asm": "Assembly", ".s": "Assembly",
    ".nim": "Nim",
    ".zig": "Zig",
    ".odin": "Odin",
    ".v": "V", ".vsh": "V",
    ".crystal": "Crystal",
    ".jl": "Julia",
    ".tcl": "Tcl",
    ".m4": "m4",
    ".make": "Makefile", ".mk": "Makefile",
    ".cmake": "CMake",
    ".proto": "Protocol Buffers",
    ".graphql": "GraphQL", ".gql": "GraphQL",
    ".sol": "Solidity",
    ".tf": "Terraform",
    ".hcl": "HCL",
    ".env": "Env",
    ".properties": "Properties",
    ".csv": "CSV",
    ".tsv": "TSV",
    ".txt": "Text",
    ".log": "Log",
}

# Language names by lower-case base name; these win over extensions.
NAME_LANGUAGE = {
    "makefile": "Makefile",
    "gnumakefile": "Makefile",
    "cmakelists.txt": "CMake",
    "dockerfile": "Dockerfile",
    "containerfile": "Dockerfile",
    "jenkinsfile": "Jenkinsfile",
    "rakefile": "Ruby",
    "gemfile": "Ruby",
    "procfile": "Procfile",
    "requirements.txt": "Python",
    "pyproject.toml": "Python",
    "setup.py": "Python",
    "package.json": "JSON",
    "composer.json": "JSON",
    "cargo.toml": "TOML",
    "go.mod": "Go",
    "gradlew": "Gradle",
    "pipfile": "Python",
    ".bashrc": "Shell",
    ".bash_profile": "Shell",
    ".zshrc": "Shell",
    ".vimrc": "Vim",
    "webpack.config.js": "JavaScript",
}

# The one name looked up after the extensions, and the fallback.
LATE_NAME_LANGUAGE = {".gitignore": "GitIgnore"}
UNKNOWN_LANGUAGE = "Unknown"


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.try_element_at(entries, key)


def language_of(path: Column) -> Column:
    """Best-guess language; never looks at the content."""
    name = F.lower(basename(path))
    return F.coalesce(
        _lookup(NAME_LANGUAGE, name),
        _lookup(EXTENSION_LANGUAGE, extension(name)),
        _lookup(LATE_NAME_LANGUAGE, name),
        F.lit(UNKNOWN_LANGUAGE),
    )
