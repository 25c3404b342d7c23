"""Fixed values that results depend on, as the query semantics define them."""

# fixed values: media types by extension
MIME = {
    "ts": "application/typescript", "tsx": "application/typescript", "js": "application/javascript", "jsx": "application/javascript", "mjs": "application/javascript", "cjs": "application/javascript",
    "json": "application/json", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "scss": "text/x-scss", "sass": "text/x-sass", "less": "text/x-less",
    "py": "text/x-python", "rb": "text/x-ruby", "go": "text/x-go", "rs": "text/x-rust", "c": "text/x-c", "h": "text/x-c", "cpp": "text/x-c++", "hpp": "text/x-c++", "cc": "text/x-c++", "java": "text/x-java",
    "kt": "text/x-kotlin", "swift": "text/x-swift", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "xml": "application/xml", "sh": "text/x-shellscript", "bash": "text/x-shellscript",
    "zsh": "text/x-shellscript", "sql": "application/sql", "graphql": "application/graphql", "gql": "application/graphql", "vue": "text/x-vue", "svelte": "text/x-svelte", "proto": "text/x-protobuf", "lock": "text/plain",
}

# fixed values: what ingestion leaves out
SKIP_DIRS = ["node_modules", "dist", "build", ".git", "vendor", "third_party", "out", "target", ".next", ".cache", ".yarn", "coverage", "__pycache__", ".gradle", ".idea", ".vscode"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock"]
BINARY_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp tiff mp3 mp4 mov avi webm ogg wav flac zip tar gz bz2 7z rar xz tgz pdf doc docx xls xlsx ppt pptx "
    "woff woff2 ttf otf eot wasm so dylib dll a lib o class jar pyc pyo exe bin dmg iso"
).split()
MAX_FILE_BYTES = 1_000_000

# fixed values: languages by extension
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "rb": "ruby", "php": "php", "vue": "vue", "svelte": "svelte", "c": "c", "h": "c", "cc": "cpp", "cxx": "cpp", "cpp": "cpp", "c++": "cpp", "hh": "cpp", "hpp": "cpp",
    "hxx": "cpp", "h++": "cpp", "m": "objc", "mm": "objc", "cs": "csharp", "scala": "scala", "zig": "zig",
}

# fixed values: words that retrieval ignores
STOP_WORDS = (
    "the and for with that this from are was were have has not but you your can will into than then when where which what how does did each any all its our out get set use used using "
    "return returns const let var function import export default new null undefined true false void type interface class public private static async await self def end if else elif while in of to is as on at by or an a"
).split()

# fixed values: request actions that count as use of a repository
REPO_ACTIONS = ["tree", "tree.json", "file", "files", "stat", "outline", "symbol", "grep", "bash", "head", "status"]

# fixed values: ordered user-agent patterns, first match wins
CLIENTS = [
    ("claude-code", r"claude-code|anthropic-claude-code"),
    ("claude", r"claudebot|claude-user|claude-web|claude-searchbot|anthropic-ai"),
    ("chatgpt", r"gptbot|chatgpt-user|chatgpt agent|oai-searchbot|\boperator\b|openai"),
    ("cursor", r"cursor"),
    ("copilot", r"copilot|github-copilot"),
    ("devin", r"devin"),
    ("perplexity", r"perplexity"),
    ("gemini", r"google-extended|googleother|notebooklm|googleagent|gemini|google-agent|google-firebase|cloudvertexbot|bedrockbot"),
    ("mistral", r"mistralai-user"),
    ("deepseek", r"deepseekbot"),
    ("cohere", r"cohere-ai|cohere-training"),
    ("meta-ai", r"meta-externalagent|meta-externalfetcher|facebookbot|facebookexternalhit"),
    ("ai-search", r"firecrawl|tavilybot|exabot|linkupbot|kagi-fetcher|youbot|phindbot"),
    ("posthog", r"posthog"),
    ("crawler", r"ccbot|diffbot|apifybot|bytespider|panscient|amazonbot|applebot|crawl4ai|webzio-extended|img2dataset|laion"),
    ("curl", r"^curl/|\(curl/|libcurl|wget|libwww"),
    ("library", r"python-requests|python-urllib|httpx|aiohttp|node-fetch|axios|got/|\bky/|okhttp|reqwest|undici"),
]

# fixed values: ranking
BM25_K1, BM25_B = 1.2, 0.75
RRF_K, RRF_DEPTH = 60, 100
SYMBOL_BOOST, TEST_BOOST, SYMBOL_TERM_BOOST, DOCS_BOOST = 1.15, 0.7, 1.2, 0.8
TEST_PATH = r"(^|/)(__tests__|test|tests|spec|fixtures?|__snapshots__|__mocks__)(/|$)|\.(test|spec)\.[a-z]+$|\.d\.ts$|\.snap$"
DOCS_EXTENSION, DOCS_DIRECTORY = r"(?i)\.(md|mdx|rst|txt|adoc)$", r"(?i)(^|/)(docs?|documentation|website|wiki)/"
CHUNK_LINES, CHUNK_WINDOW, CHUNK_STRIDE = 60, 40, 30

# fixed values: request metrics
SLOW_MS = 5000
LATENCY_EDGES = [50, 100, 250, 500, 1000, 2500, 5000]

# fixed values: words of a question that say nothing about where its answer is
QUESTION_STOP_WORDS = (
    "the a an of in on at to for from with and or not is are was were be been being this that these those it its which what where when who whom whose how why does do did "
    "file files function functions class classes method methods define defined defines definition declare declared declares export exported exports import imports implement implements implemented "
    "implementation contains contain containing has have had use uses used using set sets get gets returns return returning called call calls name named line lines path repo repository code source "
    "main root inside under near top bottom string literal value values field fields type types there here into onto via by as if then else than also just only any all some each every one two "
    "exact exactly full relative answer question about find where's whats what's i we you they them their handles handle handling logic responsible config configuration middleware component module package "
    "directory folder dir list listing"
).split()

# fixed values: patterns of quoted spans, of what stands between tokens, of what is cut off a token's ends, and of tokens
# that are written as code (camel case, Pascal case, snake case, file name, path, constant, letters with a digit or capital);
# the least length of code, of a literal and of a word; how many identifiers and words are kept
QUOTED_SPAN = r"""`[^`]{2,200}`|"[^"]{2,200}"|'[^']{3,200}'"""
TOKEN_SEPARATORS = r"[\s,;:()\[\]{}<>?!]+"
TOKEN_ENDS = r"^[^A-Za-z0-9_$@./-]+|[^A-Za-z0-9_$]+$"
CODE_SHAPES = [r"[a-z][A-Z]", r"^[A-Z][a-z]+[A-Z]", r"_", r"\.[a-z]{1,5}$", r"/", r"^[A-Z][A-Z0-9_]{2,}$", r"^[a-z]+[A-Z0-9][A-Za-z0-9]*$"]
LEAST_CODE, LEAST_LITERAL, LEAST_WORD = 3, 2, 4
MOST_IDENTIFIERS, MOST_WORDS = 8, 12

# fixed values: windows of the rate limits as (seconds, requests), for an address and for all ingests
ADDRESS_LIMITS, INGEST_LIMIT = [(10, 30), (10, 100), (60, 200)], (60, 30)
EVICT_AFTER_DAYS = 7

# fixed values: seconds that a resolved reference stays fresh, and may then be served stale, by kind
FRESHNESS = {"sha": (31_536_000, 0), "tag": (86_400, 604_800), "branch": (300, 3_600), "default": (300, 3_600)}
INGEST_STALE_SECONDS = 180
