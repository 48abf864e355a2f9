"""Settings of a run: defaults, then pyproject.toml (found upwards), then overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Table below [tool] that holds the settings; another tool's table of the same keys can be named instead.
TABLE = "tesserine"

# Default settings.
DEFAULT_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".rb", ".java", ".cs", ".c", ".h", ".cpp", ".hpp", ".cc")
DEFAULT_LANGUAGES = ("python", "typescript", "go", "rust", "ruby", "java", "csharp", "cpp")
ALL_LANGUAGES = (*DEFAULT_LANGUAGES, "javascript", "scala", "php", "swift", "elixir", "kotlin")
DEFAULT_EXCLUDE = ("**/*.test.ts", "**/*.test.tsx", "**/*.test.js", "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx", "**/*.test.py", "**/test_*.py", "**/__tests__/**", "**/tests/**", "**/test/**")
EXTENSION_TO_LANGUAGE = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".rb": "ruby", ".java": "java", ".cs": "csharp", ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".scala": "scala", ".sc": "scala", ".php": "php", ".swift": "swift", ".ex": "elixir", ".exs": "elixir", ".kt": "kotlin", ".kts": "kotlin"}
ALWAYS_EXCLUDED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".idea", ".vscode")


@dataclass(frozen=True)
class Config:
    """All settings. ``all_languages`` also reads the languages that are off by default."""

    name: str = ""
    description: str = ""
    version: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    languages: tuple[str, ...] = DEFAULT_LANGUAGES
    output_dir: str = "."
    output_summary: str = "llms.txt"
    output_full: str = "llms-full.txt"
    output_mini: str = "llms-mini.txt"
    output_diff: str = "llms-diff.txt"
    cache_path: str = ".tesserine_cache"
    include_private: bool = False
    smart_summaries: bool = True
    emit_frontmatter: bool = False
    max_tokens_summary: int = 8000
    max_tokens_full: int = 32000
    root: str = field(default_factory=lambda: str(Path.cwd()))

    @property
    def parse_opts(self) -> str:
        """What of the settings changes a parsed module; part of the cache key."""
        return f"private={int(self.include_private)}"


def find_pyproject(start: str | Path) -> Path | None:
    """The nearest pyproject.toml in ``start`` or a folder above it."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / "pyproject.toml").is_file():
            return folder / "pyproject.toml"
    return None


def load_config(root: str | Path, table: str = TABLE, **overrides) -> Config:
    """Settings for a root. Values of a wrong type are ignored; list items become strings; lists replace the defaults."""
    root = Path(root)
    values: dict = {"root": str(root), "name": root.resolve().name}
    found = find_pyproject(root)
    if found:
        with found.open("rb") as f:
            data = tomllib.load(f)
        project = data.get("project", {})
        values |= {k: project[k] for k in ("name", "description", "version") if isinstance(project.get(k), str)}
        defaults = Config()
        for f_ in fields(Config):
            given = data.get("tool", {}).get(table, {}).get(f_.name)
            if given is None or f_.name == "root":
                continue
            default = getattr(defaults, f_.name)
            if isinstance(default, tuple):
                if isinstance(given, list):
                    values[f_.name] = tuple(str(x) for x in given)
            elif isinstance(default, bool):
                if isinstance(given, bool):
                    values[f_.name] = given
            elif isinstance(given, type(default)):
                values[f_.name] = given
    values |= {k: v for k, v in overrides.items() if v is not None}
    return Config(**values)
