"""Constants. Lists and numbers below are fixed values: results depend on them."""

from __future__ import annotations

# ---- files (fixed values)
BLOCKED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "dist", "build", ".next", "target", ".gradle",
    "vendor", "coverage", "htmlcov", ".eggs", "site-packages", ".cache", ".idea", ".vscode", ".claude", ".quarrygraph",
]
BLOCKED_EXTENSIONS = [".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".exe", ".o", ".a", ".wasm"]
BLOCKED_NAMES = ["*.min.js", "*.min.css", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "uv.lock", "*.lock"]
GENERATED_SUFFIXES = ["_pb2.py", "_pb2_grpc.py", "_pb.ts", "_pb.js", "_grpc.pb.go"]
GENERATED_MARKERS = ["Code generated", "DO NOT EDIT", "This file was automatically generated", "GENERATED CODE", "AUTO-GENERATED", "@generated"]
NO_GENERATED_CHECK = ["json", "yaml", "toml", "markdown", "sql", "shell", "terraform", "proto", "graphql", "dockerfile", "makefile", "vue"]
CONFIG_LANGUAGES = ["yaml", "toml", "json", "dockerfile", "makefile"]
ENTRY_NAMES = [
    "main.py", "app.py", "run.py", "server.py", "wsgi.py", "asgi.py", "index.ts", "index.js", "main.ts", "main.js", "app.ts", "main.go", "main.rs", "lib.rs", "Main.java",
    "Application.java",
]
ENTRY_STEMS = ["main", "index", "app", "run", "server", "start", "wsgi", "asgi"]
MAX_FILE_BYTES = 500 * 1024
SPECIAL_NAMES = {"Dockerfile": "dockerfile", "dockerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile"}
EXTENSION_LANGUAGE = {
    ".py": "python", ".pyi": "python", ".ipynb": "python",
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".lua": "lua",
    ".r": "r",
    ".ex": "elixir", ".exs": "elixir",
    ".hs": "haskell",
    ".ml": "ocaml", ".mli": "ocaml",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".proto": "proto",
    ".graphql": "graphql", ".gql": "graphql",
    ".tf": "terraform", ".hcl": "terraform",
    ".md": "markdown", ".mdx": "markdown",
    ".sql": "sql",
    ".vue": "vue",
}

# ---- graph (fixed values)
EXTERNAL = "external:"
IMPORTS, TESTED_BY = "IMPORTS_FROM", "TESTED_BY"
PAGERANK_ALPHA, PAGERANK_ROUNDS, PAGERANK_TOLERANCE = 0.85, 100, 1e-6
BETWEENNESS_EXACT_BELOW, BETWEENNESS_SAMPLE = 30_000, 500
TSCONFIG_SKIP_DIRS = ["node_modules", "dist", "build", ".next", ".nuxt", ".output", "__pycache__", ".git", ".quarrygraph", ".turbo", ".vercel"]
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
SCRIPT_INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

# ---- flows and risk (fixed values)
SECURITY_KEYWORDS = [
    "auth", "login", "password", "token", "secret", "credential", "encrypt", "decrypt", "hash", "session", "permission", "admin", "api_key", "apikey", "oauth", "jwt", "csrf",
    "sanitize", "validate", "certificate", "private_key",
]
CONVENTIONAL_STEMS = ["main", "app", "index", "server", "cli", "handler", "__main__"]
FLOW_DEPTH, IMPACT_DEPTH = 15, 3
COUPLING_LEAST, COUPLING_MODERATE, COUPLING_HIGH = 3, 5, 10

# ---- dead code (fixed values)
NON_CODE_LANGUAGES = ["json", "yaml", "toml", "markdown", "sql", "shell", "terraform", "proto", "graphql", "dockerfile", "makefile", "unknown"]
NEVER_FLAG = [
    "*__init__.py", "*__main__.py", "*conftest.py", "*alembic/env.py", "*manage.py", "*wsgi.py", "*asgi.py", "*migrations*", "*schema*", "*seed*", "*.d.ts", "*setup.py",
    "*setup.cfg", "*next.config.*", "*vite.config.*", "*tailwind.config.*", "*postcss.config.*", "*jest.config.*", "*vitest.config.*", "**/app/**/page.tsx", "**/app/**/page.ts",
    "**/app/**/route.tsx", "**/app/**/route.ts", "**/app/**/layout.tsx", "**/app/**/layout.ts", "**/app/**/loading.tsx", "**/app/**/error.tsx", "**/app/**/not-found.tsx",
    "**/app/**/template.tsx", "**/app/**/default.tsx", "**/pages/**/*.tsx", "**/pages/**/*.ts", "middleware.ts", "middleware.js", "instrumentation.ts", "instrumentation.js",
    "**/app/global-error.tsx", "**/app/global-error.ts", "**/app/**/opengraph-image.tsx", "**/app/**/twitter-image.tsx", "**/app/**/sitemap.ts", "**/app/**/robots.ts",
    "*.config.ts", "*.config.js", "*.config.cjs", "*.config.mjs", "content-collections.ts", "content-collections.js", "*-sitemap.config.*", "*biome.json*", "*.eslintrc*",
    "*.prettierrc*", "*babel.config.*", "*tsconfig*.json", "*jsconfig*.json", "scripts/*", "bin/*", "tools/*",
]
DYNAMIC_NAMES = ["*Plugin", "*Handler", "*Adapter", "*Middleware", "register_*", "on_*"]
FIXTURE_SEGMENTS = ["fixture", "fixtures", "testdata", "test_data", "sample_repo", "mock_data", "test_assets"]
PACKAGE_MARKERS = ["package.json", "__init__.py"]
OLD_DAYS, RECENT_DAYS = 180, 90
MIN_CONFIDENCE = 0.4

# ---- history (fixed values)
HALF_LIFE_DAYS, CO_CHANGE_TAU_DAYS, CO_CHANGE_LEAST, COMMIT_LIMIT = 180.0, 180.0, 3.0, 500
CATEGORY_PATTERNS = {
    "feature": r"\b(add|implement|introduce|create|new|feat)\b",
    "refactor": r"\b(refactor|restructure|cleanup|clean.up|rename|reorganize|extract|simplify|move)\b",
    "fix": r"\b(fix|bug|patch|hotfix|revert|regression|broken|crash|error)\b",
    "dependency": r"\b(upgrade|bump|update.dep|migrate.to|switch.to|dependency|dependencies)\b",
}
HISTORY_EXTENSIONS = [
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".cs", ".rb",
    ".php", ".swift",
]

# ---- search (fixed values)
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
CASE_BOOST = 1.5
CLASS_KINDS, FUNCTION_KINDS = ["class", "interface", "struct", "enum"], ["function", "method"]

# ---- refactoring (fixed values)
LARGE_FUNCTION_LINES = 50
PREVIEW_MINUTES = 10

# ---- frameworks (fixed values): dependency names in the order they are tried, and entry globs
SCRIPT_FRAMEWORKS = [
    ("nextjs", ["next"], [
        "**/app/**/page.tsx", "**/app/**/page.ts", "**/app/**/page.jsx", "**/app/**/page.js", "**/app/**/route.tsx", "**/app/**/route.ts", "**/app/**/route.jsx",
        "**/app/**/route.js", "**/app/**/layout.tsx", "**/app/**/layout.ts", "**/app/**/layout.jsx", "**/app/**/layout.js", "**/app/**/loading.tsx", "**/app/**/loading.ts",
        "**/app/**/error.tsx", "**/app/**/error.ts", "**/app/**/not-found.tsx", "**/app/**/not-found.ts", "**/app/**/template.tsx", "**/app/**/template.ts",
        "**/app/**/default.tsx", "**/app/**/default.ts", "**/app/**/global-error.tsx", "**/app/**/opengraph-image.tsx", "**/app/**/twitter-image.tsx", "**/app/**/sitemap.ts",
        "**/app/**/robots.ts", "**/pages/**/*.tsx", "**/pages/**/*.ts", "**/pages/**/*.jsx", "**/pages/**/*.js", "middleware.ts", "middleware.js", "instrumentation.ts",
        "instrumentation.js", "next.config.*",
    ]),
    ("nuxt", ["nuxt", "nuxt3"], ["**/pages/**/*.vue", "**/layouts/**/*.vue", "**/middleware/**/*.ts", "**/server/api/**/*.ts", "**/server/routes/**/*.ts", "**/plugins/**/*.ts", "nuxt.config.*"]),
    ("vite", ["vite"], ["index.html", "src/main.*", "src/App.*"]),
    ("react", ["react"], ["src/index.*", "src/App.*", "public/index.html"]),
    ("vue", ["vue"], ["src/main.*", "src/App.*"]),
    ("svelte", ["svelte", "@sveltejs/kit"], ["src/routes/**/+page.svelte", "src/routes/**/+layout.svelte", "src/routes/**/+server.*"]),
]
PYTHON_FRAMEWORKS = [
    ("django", ["**/urls.py", "**/views.py", "**/admin.py", "**/models.py", "**/forms.py", "**/serializers.py", "manage.py", "**/wsgi.py", "**/asgi.py"]),
    ("fastapi", ["main.py", "app.py", "**/routers/*.py"]),
    ("flask", ["app.py", "wsgi.py", "**/routes/*.py"]),
]
