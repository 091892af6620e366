"""Lists, limits and labels that results depend on."""

# Accounts that write code with a model.
CODING_AGENT_LOGINS = (
    "copilot-swe-agent",
    "copilot",
    "cursor-agent",
    "devin-ai-integration",
    "sweep-ai",
    "google-labs-jules",
    "codegen-sh",
)

# Accounts that review code with a model.
REVIEW_BOT_LOGINS = (
    "copilot-pull-request-reviewer",
    "coderabbitai",
    "sourcery-ai",
    "greptile",
    "qodo-merge-pro",
    "gemini-code-assist",
)

# Automation without a model.
AUTOMATION_LOGINS = (
    "dependabot",
    "renovate",
    "renovate-bot",
    "github-actions",
    "codecov",
    "codecov-commenter",
    "stale",
    "mergify",
    "netlify",
    "vercel",
    "allcontributors",
    "pre-commit-ci",
    "semantic-release-bot",
)

# Comment authors that do not count as human.
NON_HUMAN_COMMENT_AUTHORS = CODING_AGENT_LOGINS + REVIEW_BOT_LOGINS + (
    "github-actions",
    "codecov",
    "codecov-commenter",
    "azure-pipelines",
)

# Confidence of each detection rule.
CONFIDENCE_LISTED_BOT = 0.95
CONFIDENCE_LISTED_USER = 0.90
CONFIDENCE_HUMAN = 0.90
CONFIDENCE_OTHER_BOT = 0.95
CONFIDENCE_COMMIT_IDENTITY = 0.80
CONFIDENCE_INITIAL_PLAN = 0.70
CONFIDENCE_UNKNOWN = 0.0

# First commit message of a coding agent, and its login.
INITIAL_PLAN = "initial plan"
INITIAL_PLAN_LOGIN = "copilot-swe-agent"

# Sampling and split sizes.
TARGET_PER_REPO = 300
PRIORITY_CAP = 100
TRAIN_FRACTION = 0.8
SEED = 42
FOLDS = 5
AUDIT_SIZE = 40

# Feature columns by family.
MODIFICATION_COLUMNS = [
    "m_additions", "m_deletions", "m_churn", "m_net_change", "m_changed_files",
    "m_avg_file_churn", "m_frac_added", "m_num_hunks",
    "m_files_added", "m_files_modified", "m_files_removed", "m_files_renamed",
    "m_num_commits",
]
STRUCTURE_COLUMNS = [
    "s_ast_node_count", "s_ast_max_depth", "s_cfg_node_count", "s_cfg_edge_count",
    "s_cyclomatic_proxy", "s_num_functions_touched", "s_has_parseable_code",
]
TEXT_COLUMNS = [
    "t_title_len", "t_title_wordcount", "t_body_len", "t_body_wordcount",
    "t_body_is_empty", "t_commit_msg_len_first", "t_commit_msg_len_mean",
    "t_commit_msg_len_total",
]
PROCESS_COLUMNS = [
    "p_num_reviews", "p_num_reviewers", "p_num_review_comments",
    "p_num_issue_comments", "p_has_changes_requested", "p_has_approved",
    "p_is_ai_reviewed", "p_n_ai_reviewers", "num_labels",
]
HISTORY_COLUMNS = ["author_prior_merge_rate", "author_prior_pr_count"]
CARRIER_COLUMNS = ["pr_id", "y", "created_at", "repo"]
DROPPED_IN_V2 = ["m_num_commits", "t_commit_msg_len_total"]

V1_COLUMNS = MODIFICATION_COLUMNS + STRUCTURE_COLUMNS + TEXT_COLUMNS
V2_COLUMNS = [c for c in V1_COLUMNS if c not in DROPPED_IN_V2] + HISTORY_COLUMNS
V0_COLUMNS = V1_COLUMNS + PROCESS_COLUMNS
VARIANT_COLUMNS = {"v0": V0_COLUMNS, "v1": V1_COLUMNS, "v2": V2_COLUMNS}

# Columns whose role in preprocessing is not "log count".
BOOL_COLUMNS = [
    "s_has_parseable_code", "t_body_is_empty",
    "p_has_changes_requested", "p_has_approved", "p_is_ai_reviewed",
]
SIGNED_COLUMNS = ["m_net_change"]
RATIO_COLUMNS = ["m_frac_added", "author_prior_merge_rate"]

# Name prefix and label of each feature group.
FEATURE_GROUPS = (
    ("m_", "M -- code modification"),
    ("s_", "S -- code structure"),
    ("t_", "T -- textual"),
    ("author_", "author history (V2 only)"),
    ("p_", "P -- process/forbidden (V0 only)"),
    ("num_labels", "P -- process/forbidden (V0 only)"),
)

# File extensions of each analysed language.
PYTHON_EXTENSIONS = ("py",)
TYPESCRIPT_EXTENSIONS = ("ts", "js", "mjs", "cjs", "tsx", "jsx")
CSHARP_EXTENSIONS = ("cs",)

# Text budgets, in characters or entries.
DIFF_BUDGET = 16_000
FILE_PATCH_BUDGET = 4_000
COMMIT_BUDGET = 4_000
FILE_LIST_LENGTH = 30
AUGMENTED_DIFF_BUDGET = 1_200
AUGMENTED_FILE_BUDGET = 500
AUGMENTED_SECTION_BUDGET = 600
AUGMENTED_REPO_FILES = 8
REPO_CONTEXT_FILES = 20
HISTORY_COMMENTS = 2
HISTORY_COMMENT_BUDGET = 350
HUNK_HEADINGS_PER_FILE = 5
DEMO_DIFF_BUDGET = 1_500
DEMO_COMMENT_BUDGET = 600
DEMO_COUNT = 2
MIN_DEMO_COMMENT_CHARS = 40
MIN_TRUTH_COMMENT_CHARS = 12

# Truncation markers.
FILE_MARKER = "\n... [file diff truncated]"
CONTEXT_MARKER = "\n... [context truncated to fit the LLM token budget]"
DEMO_DIFF_MARKER = "\n... [diff truncated]"
SECTION_MARKER = " ... [truncated for length]"
COMMENT_MARKER = " ..."

# Grid axes.
TASKS = ["merge_prediction", "review_comment"]
CONTEXT_KINDS = ["diff_only", "diff_description", "diff_commit_message", "diff_metadata"]
STRATEGIES = ["zero_shot", "few_shot", "cot", "role_based"]
TIERS = ["diff", "diff_pr_description", "diff_repo_context", "diff_issue", "complete_se_context"]
AUGMENTED_STRATEGIES = ["role_based", "few_shot", "cot", "self_reflection", "multi_turn"]
SHARED_STRATEGIES = ["role_based", "few_shot", "cot"]
CELLS_PER_PR = 32
AUGMENTED_CELLS_PER_PR = 48

# Sections of each tier, in order: heading, column, text when empty.
TIER_SECTIONS = {
    "diff": [],
    "diff_pr_description": [
        ("PR description", "pr_description", "no PR description provided"),
    ],
    "diff_repo_context": [
        ("Repository context", "repo_context", "no repository context available"),
    ],
    "diff_issue": [
        ("Linked issue", "issue_text", "no linked issue information available"),
    ],
    "complete_se_context": [
        ("PR description", "pr_description", "no PR description provided"),
        ("Commit messages", "commit_message", "no commit messages available"),
        ("Linked issue", "issue_text", "no linked issue information available"),
        ("Repository context", "repo_context", "no repository context available"),
        ("Historical review comments on similar past PRs", "historical_comments",
         "no historical review comments available"),
    ],
}

# Tokens of each answer class; the weak ones count only in a decision line.
MERGE_TOKENS = ["merged", "merge", "accepted", "accept", "approved", "approve"]
CLOSE_TOKENS = ["closed", "close", "rejected", "reject", "declined", "decline"]
MERGE_WEAK_TOKENS = ["yes"]
CLOSE_WEAK_TOKENS = ["no"]

# Reading of a probability against the base rate.
DECISION_THRESHOLD = 0.5
LEVEL_TOLERANCE = 0.02
INLINE_LABEL_CHARS = 60
MIN_SYMBOL_CHARS = 3
