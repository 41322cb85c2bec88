"""The names, suffixes and patterns that classify files, as text in natural order."""

# Extensions of source-like, asset and binary files, and names that are source-like without one.
SOURCE_EXT = ".go .java .py .js .jsx .ts .tsx .mjs .cjs .cpp .c .h .hpp .rs .rb .php .cs .kt .swift .html .htm .css .scss .sass .json .yaml .yml .toml .xml .ini .conf .properties .md .txt .webmanifest .sh .bash .zsh .sql".split()
ASSET_EXT = ".png .jpg .jpeg .gif .webp .svg .ico .woff .woff2 .ttf .otf .mp3 .mp4 .mov .webm".split()
BINARY_EXT = ".exe .dll .so .dylib .class .jar .war .ear .zip .tar .gz .tgz .bz2 .xz .7z .rar .pdf .wasm .bin".split()
SOURCE_NAMES = "package.json package-lock.json pnpm-lock.yaml yarn.lock vite.config.js vite.config.ts next.config.js next.config.ts webpack.config.js tsconfig.json jsconfig.json index.html readme readme.md agents.md license makefile dockerfile taskfile.yml justfile".split()
SCRIPT_EXT = ".sh .bash .zsh".split()

# Sensitive names, exceptions, suffixes.
SENSITIVE_NAMES = ".env .npmrc .pypirc .netrc credentials credentials.json secret.json secrets.json id_rsa id_dsa id_ecdsa id_ed25519".split()
ENV_EXAMPLES = ".env.example .env.template .env.sample".split()
SENSITIVE_SUFFIXES = ".pem .key .p12 .pfx .kubeconfig _rsa _dsa _ecdsa _ed25519".split()
SENSITIVE_PATHS = r"(^|/)([.]azure(/|$)|[.]aws/(credentials|config)(/|$)|[.]gcp/credentials[.]json(/|$))"

# Guidance documents, manifests and configuration by name.
GUIDANCE = "agents.md readme.md contributing.md claude.md gemini.md codex.md".split()
MANIFESTS = "package.json go.mod pom.xml build.gradle build.gradle.kts pyproject.toml cargo.toml".split()
CONFIGS = "tsconfig.json jsconfig.json vite.config.js vite.config.ts vite.config.mjs vite.config.cjs next.config.js next.config.ts next.config.mjs next.config.cjs dockerfile docker-compose.yml docker-compose.yaml makefile taskfile.yml taskfile.yaml justfile go.sum requirements.txt setup.py setup.cfg package.xml cmakelists.txt".split()
ROOT_WEB = "sitemap.xml robots.txt manifest.json site.webmanifest favicon.ico apple-touch-icon.png favicon-32x32.png favicon-16x16.png browserconfig.xml og-image.png og-image.jpg social-preview.png social-preview.jpg social-card.png social-card.jpg opengraph.png opengraph.jpg".split()
CONTROL_NAMES = "dockerfile makefile taskfile.yml justfile readme.md agents.md license contributing.md claude.md gemini.md codex.md".split()
CONFIG_EXT = ".toml .yaml .yml .json .xml .ini .conf .properties".split()
RESOURCE_EXT = ".sql .proto .graphql .gql".split()
NOISE = ".ds_store thumbs.db go.sum package-lock.json pnpm-lock.yaml yarn.lock .gitignore .dockerignore".split()
COMPILED_EXT = ".exe .dll .so .dylib .class .jar .war".split()

# Operations directories, files and words.
OPS_DIRS = "deploy deployment deployments ops infra infrastructure ci build-scripts automation provision provisioning release releases packaging dist-scripts docker containers k8s kubernetes helm terraform tofu opentofu ansible puppet chef salt packer nomad systemd supervisor nginx apache cloud aws gcp azure .gitlab .circleci .buildkite".split()
ROOT_OPS = "makefile dockerfile docker-compose.yml docker-compose.yaml compose.yml compose.yaml taskfile.yml taskfile.yaml justfile .gitlab-ci.yml .gitlab-ci.yaml".split()
ROOT_OPS_SUFFIXES = ".sh .bash .zsh .fish .ps1 .bat .cmd".split()
OPS_NAMES = "dockerfile docker-compose.yml docker-compose.yaml compose.yml compose.yaml makefile taskfile.yml taskfile.yaml justfile flake.nix shell.nix".split()
OPS_SUFFIXES = ".sh .bash .zsh .fish .ps1 .bat .cmd .py .rb .pl .js .ts .mjs .cjs .sql .service .timer .yml .yaml .json .toml .tf .tfvars .hcl .ini .conf .properties".split()
OPS_DOC_WORDS = "readme manual runbook deploy deployment provision release ops infra".split()
OPS_RUNBOOK_WORDS = "runbook manual deploy deployment provision release".split()
OPS_VERBS = "deploy deployment provision release start stop restart run diagnose check health status backup restore import export migration schema seed".split()
OPS_REAL_ENV = ".env .env.local .env.production .env.development .env.test".split()

# Directories that walks and reviews pass over, and those that name a review category.
IGNORED_DIRS = ".git node_modules target build".split()
MARKER_IGNORED_DIRS = [*IGNORED_DIRS, "vendor", "dist", ".gocache", ".idea", ".vscode"]
CATEGORY_DIRS = "test tests testdata fixture fixtures migration migrations migrate schema sample".split()
STATIC_DIRS = "public static assets".split()
EXAMPLE_DIRS = "example examples sample samples demo demos".split()

# Limits.
MARKER_DEPTH, PACKAGE_TOP, ROOT_TOP, DOCS_TOP, GENERIC_TOP, OPS_TOP = 4, 3, 10, 5, 10, 5
MAP_BYTES, PROMPT_BYTES, FILE_BYTES, MAX_PACKAGES = 512 << 10, 192 << 10, 50 << 10, 50
DIR_FILES, SCAN_FILES, REVIEW_BYTES, REVIEW_FILE_BYTES, UNTRACKED = 250, 10_000, 512 << 10, 64 << 10, 25
BRACE_LINES, INDENT_LINES, DECLARATION_LINES, SMALL_LINES, SMALL_BYTES, LINES_BEFORE, LINES_AFTER = 48, 24, 24, 24, 4096, 3, 6

# Languages by extension.
LANGUAGES = {".go": "Go", ".java": "Java", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift", ".cpp": "C++", ".c": "C"}

# Language detectors as (language, marker names, extensions, deepest marker; None: any depth); without
# markers a file of the language is evidence enough and the project is the module.
DETECTORS = [
    ("Go", ["go.mod"], [".go"], MARKER_DEPTH),
    ("Java", ["pom.xml", "build.gradle", "build.gradle.kts"], [".java"], None),
    ("Node", ["package.json"], ".js .jsx .ts .tsx .mjs .cjs".split(), MARKER_DEPTH),
    ("Python", [], [".py"], None),
]

# What external directories leave out, and the limits of a goal's preview and of review budgets.
EXTERNAL_NOISE = ".ds_store thumbs.db go.sum package-lock.json pnpm-lock.yaml yarn.lock".split()
GOAL_LINES, GOAL_BYTES, TOPOLOGY_RESERVE = 3, 96, 40 << 10

# Source roots of a Java module in the order in which they are tried, and extensions of resources in them.
JAVA_ROOTS = "src/main/java src/test/java src/main src/java src".split()
JAVA_RESOURCES = ".xml .properties .yaml .yml .sql .proto .json .txt".split()

# Node sources, commands that are no paths, files at a module's root that an overview looks for.
NODE_EXT = ".js .jsx .cjs .mjs .ts .tsx .cts .mts".split()
NODE_COMMANDS = "node tsx ts-node ts-node-esm nodemon vite vitest jest mocha tsx-watch".split()
NODE_ROOT_FILES = "package.json tsconfig.json jsconfig.json server.ts server.js main.ts main.js index.ts index.js index.html".split()

# Frameworks in their order as (name, dependencies, paths that prove it in a map, further ones that prove it in an overview, files and
# directories that an overview shows).
_NEXT_CONFIG = "next.config.js next.config.ts next.config.mjs next.config.cjs".split()
_VITE_CONFIG = "vite.config.js vite.config.ts vite.config.mjs vite.config.cjs".split()
FRAMEWORKS = [
    ("React", ["react"], "src/App.jsx src/App.tsx App.jsx App.tsx components hooks".split(), "src/components src/hooks".split(),
     "App.jsx App.tsx src/App.jsx src/App.tsx main.jsx main.tsx index.jsx index.tsx src/main.jsx src/main.tsx src/index.jsx src/index.tsx".split(), "components hooks src/components src/hooks".split()),
    ("Next.js", ["next"], [*_NEXT_CONFIG, "pages", "app"], [],
     [*_NEXT_CONFIG, *"pages/index.jsx pages/index.tsx pages/index.js pages/index.ts app/page.jsx app/page.tsx app/page.js app/page.ts".split()], "pages app".split()),
    ("Vue", ["vue"], "src/App.vue App.vue components".split(), "src/main.ts src/main.js main.ts main.js src/components".split(), "src/main.ts src/main.js main.ts main.js src/App.vue App.vue".split(), "components src/components".split()),
    ("Vite", ["vite"], [*_VITE_CONFIG, "index.html"], [], [*_VITE_CONFIG, *"main.jsx main.tsx main.js main.ts src/main.jsx src/main.tsx src/main.js src/main.ts".split()], []),
    ("NestJS", ["@nestjs/core", "@nestjs/common"], "nest-cli.json src/main.ts src/main.js".split(), "apps libs".split(), "nest-cli.json src/main.ts src/main.js".split(), "apps libs".split()),
]
#: Build systems by marker, before the frameworks.
BUILD_MARKERS = [("Maven", ["pom.xml"]), ("Gradle", ["build.gradle", "build.gradle.kts"]), ("Go Modules", ["go.mod"]), ("Node.js", ["package.json"])]
#: Ranks of overview files: names anywhere, names at the root, and beginnings of paths.
OVERVIEW_NAMES = [["package.json"], ["tsconfig.json", "jsconfig.json"], [*_NEXT_CONFIG, *_VITE_CONFIG, "nest-cli.json"]]
OVERVIEW_ROOT_NAMES = [["server.ts", "server.js"], ["main.ts", "main.js"], ["index.ts", "index.js"], ["index.html"], ["app.tsx", "app.jsx", "app.ts", "app.js"]]
OVERVIEW_STARTS = [["pages/", "app/"], ["components/", "hooks/", "src/components/", "src/hooks/"], ["server/"], ["apps/"], ["libs/"], ["bin/"]]
