"""Schemas and vocabularies of the property graph.

``ord`` is the position of a row in its source.  Rules that depend on order (first or
last write wins, ties) use it; nothing depends on the order of partitions.
"""

NODE_SCHEMA = "id STRING, label STRING, file_type STRING, source_file STRING, source_location STRING, norm_label STRING, community INT, repo STRING, local_id STRING, metadata MAP<STRING,STRING>, ord BIGINT"
EDGE_SCHEMA = "src STRING, dst STRING, relation STRING, confidence STRING, confidence_score DOUBLE, context STRING, weight DOUBLE, source_file STRING, source_location STRING, ord BIGINT"
HYPER_SCHEMA = "id STRING, label STRING, members ARRAY<STRING>, relation STRING, confidence STRING, confidence_score DOUBLE, source_file STRING"

# Vocabularies that graph files are written in.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
STRUCTURAL_RELATIONS = ["imports", "imports_from", "contains", "method"]
IMPACT_RELATIONS = ["calls", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds"]
DEFAULT_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
JSON_NOISE_LABELS = ["start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies"]

# Families of languages by file suffix. Build and scoring use different tables.
BUILD_FAMILIES = {"py": ["py", "pyi"], "js": ["js", "mjs", "cjs", "jsx", "ts", "tsx"], "go": ["go"], "rs": ["rs"], "jvm": ["java", "kt", "scala", "groovy"], "c": ["c", "h"], "cpp": ["cc", "cpp", "hpp"], "rb": ["rb"], "php": ["php"], "cs": ["cs"], "swift": ["swift"], "lua": ["lua"]}
SCORE_FAMILIES = {"python": ["py", "pyw"], "js": ["js", "jsx", "mjs", "ejs", "ts", "tsx", "vue", "svelte"], "go": ["go"], "rust": ["rs"], "jvm": ["java", "kt", "kts", "scala"], "c": ["c", "h", "cpp", "cc", "cxx", "hpp"], "ruby": ["rb"], "swift": ["swift"], "dotnet": ["cs"], "php": ["php"], "r": ["r"]}

# File suffixes by kind.
CODE_SUFFIXES = "py ts tsx js jsx mjs ejs ets go rs java groovy gradle cpp cc cxx c h hpp rb swift kt kts cs scala php lua luau toc zig ps1 ex exs m mm jl vue svelte astro dart v sv svh sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc dfm lfm lpk sh bash json dm dme dmi dmm dmf sln csproj fsproj vbproj razor cshtml".split()
DOC_SUFFIXES = "md mdx qmd txt rst html yaml yml".split()
PAPER_SUFFIXES = ["pdf"]
IMAGE_SUFFIXES = "png jpg jpeg gif webp svg".split()
OFFICE_SUFFIXES = ["docx", "xlsx"]
WORKSPACE_SUFFIXES = ["gdoc", "gsheet", "gslides"]
VIDEO_SUFFIXES = "mp4 mov webm mkv avi m4v mp3 wav m4a ogg".split()
