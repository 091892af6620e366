"""The texts a model is sent.  ``{...}`` marks a slot filled per row.

The wording decides the model's answers and the keys of stored answers, so it is
data, not logic.
"""

# Answer formats.
MERGE_CONTRACT = """End your response with exactly these two lines and nothing after them:
DECISION: MERGE        (if you predict the PR was merged)
   or
DECISION: CLOSE        (if you predict it was closed without merging)
CONFIDENCE: <number between 0.0 and 1.0 = your probability that it was merged>"""

REVIEW_CONTRACT = """Put your final review inside a single block delimited exactly like this:
<review>
- <one concrete, actionable comment about specific code>
- <another comment>
</review>
Write one comment per '- ' bullet, refer to specific code, and write nothing after </review>. If the change looks fine, put a single bullet saying so."""

CONTRACTS = {"merge_prediction": MERGE_CONTRACT, "review_comment": REVIEW_CONTRACT}

# System messages.
ASSISTANT = "You are a code-review assistant. You answer precisely and follow the required output format exactly."
MERGE_MAINTAINER = (
    "You are a senior maintainer of {project} with commit access -- the person who decides whether a pull request is "
    "merged. You have reviewed thousands of PRs. You hold a high bar: you gate merges on correctness, adequate testing, "
    "disciplined scope, and adherence to project conventions, and you are wary of large, risky, or unfocused changes. "
    "You can judge quickly whether a change is merge-ready."
)
REVIEW_MAINTAINER = (
    "You are a senior maintainer of {project} performing code review. You review with this priority order: "
    "(1) correctness, (2) security, (3) test coverage, (4) maintainability, (5) style. You focus on merge-blocking "
    "issues and keep every comment concise, specific, and actionable -- never generic praise, and never exhaustive "
    "linter-style nitpicking."
)

SYSTEMS = {
    ("merge_prediction", "zero_shot"): ASSISTANT,
    ("merge_prediction", "few_shot"): ASSISTANT,
    ("merge_prediction", "cot"): ASSISTANT + " Reason carefully and step by step before committing to an answer.",
    ("merge_prediction", "role_based"): MERGE_MAINTAINER,
    ("review_comment", "zero_shot"): ASSISTANT,
    ("review_comment", "few_shot"): ASSISTANT,
    ("review_comment", "cot"): ASSISTANT + " Reason carefully and step by step before writing the final review.",
    ("review_comment", "role_based"): REVIEW_MAINTAINER,
}

# Task statements.
MERGE_FRAME = (
    "Task: MERGE PREDICTION. Decide whether the pull request below was ultimately MERGED into {project} or CLOSED "
    "without merging, judging only from its content."
)
REVIEW_FRAME = (
    "Task: REVIEW COMMENT GENERATION. Write the code-review comments a reviewer would leave on the pull request below "
    "from {project}."
)

# User messages.
USERS = {
    ("merge_prediction", "zero_shot"): MERGE_FRAME + """

{content}

Give your decision directly.

""" + MERGE_CONTRACT,
    ("merge_prediction", "few_shot"): MERGE_FRAME + """

Here are {n_demos} labelled examples of past pull requests and whether each was merged or closed. Infer the pattern that separates merged from closed PRs, then classify the final one.

{demos}

### Pull request to classify
{content}

""" + MERGE_CONTRACT,
    ("merge_prediction", "cot"): MERGE_FRAME + """

{content}

Reason through these steps explicitly before you decide:
1. Scope & risk: how large is the change (lines, files)? Does it touch core or high-risk code?
2. Completeness & correctness: does the diff look self-contained and correct? Are there tests, or TODOs, debug leftovers, or obvious defects?
3. Alignment with intent: does the change match its stated title and description, or is there unexplained scope creep?
4. Maturity signals: any WIP markers, or very large / scattered / unfocused churn that suggests an unfinished or contested change?
Then weigh these factors and give a calibrated decision. A typical mature repository merges most PRs, so treat CLOSE as the claim that needs the stronger evidence.

""" + MERGE_CONTRACT,
    ("merge_prediction", "role_based"): MERGE_FRAME + """

{content}

Apply your own merge criteria as the maintainer and decide whether you would have merged this PR.

""" + MERGE_CONTRACT,
    ("review_comment", "zero_shot"): REVIEW_FRAME + """

{content}

Write your review comments directly.

""" + REVIEW_CONTRACT,
    ("review_comment", "few_shot"): REVIEW_FRAME + """

Below are {n_demos} real review comments left by human maintainers on past pull requests, each with the change it commented on. Match their style -- concise, specific, and focused on what actually matters -- when you review the final PR.

{demos}

### Pull request to review
{content}

""" + REVIEW_CONTRACT,
    ("review_comment", "cot"): REVIEW_FRAME + """

{content}

Work in three explicit stages before producing the review:
1. Analyze: read the diff and list every concrete observation -- possible correctness bugs, missing tests or unhandled edge cases, security or performance concerns, error handling, naming, and API/design issues.
2. Prioritize: keep only the issues a maintainer would actually raise before merging; drop trivial nitpicks.
3. Write: turn each kept issue into one concise, actionable comment anchored to the specific code.

""" + REVIEW_CONTRACT,
    ("review_comment", "role_based"): REVIEW_FRAME + """

{content}

Leave the review comments you would leave as the maintainer, in your priority order.

""" + REVIEW_CONTRACT,
}

# One demonstration inside a few-shot message.
DEMONSTRATIONS = {
    "merge_prediction": """### Example {i}
{context}
DECISION: {target}""",
    "review_comment": """### Example {i} -- change under review
{context}
Reviewer comment: {target}""",
}

# Second message of the two-turn strategies.
SECOND_TURNS = {
    ("merge_prediction", "self_reflection"): """Now step back and critique your own draft decision above as a skeptical senior reviewer.
This pull request was written by an AI coding agent, and AI-generated changes are prone to looking plausible while being subtly wrong: hallucinated or misused APIs, missing edge cases and error handling, tests that assert the wrong thing, and edits broader than the task needs. Check specifically:
- Did you over- or under-weight the change's risk and completeness?
- Is your stated confidence calibrated, or just anchored on the fact that most PRs merge?
- Would the maintainers of {project} actually have merged this, given what the diff really shows?
Then give your final, reconsidered decision.

""" + MERGE_CONTRACT,
    ("review_comment", "self_reflection"): """Now critique your own draft review above before finalising it. This pull request was written by an AI coding agent, so a second, skeptical pass is worth it. Check your draft for:
- real issues you missed (correctness bugs, missing tests or edge cases, hallucinated or misused APIs, security or performance problems);
- comments that are vague, generic, or not anchored to specific code;
- any claim you cannot actually support from the diff -- fix or drop it.
Then produce your improved final review.

""" + REVIEW_CONTRACT,
    ("merge_prediction", "multi_turn"): """Here is additional software-engineering context about this change that was not in the diff alone:

{second}

This pull request was written by an AI coding agent. AI-generated code often looks correct in isolation yet conflicts with the surrounding codebase or misreads the change's real intent -- which is only visible with this broader context.
Re-examine your decision in light of it: does the change actually fit the code it touches and satisfy the intent above? Give your final, reconsidered decision.

""" + MERGE_CONTRACT,
    ("review_comment", "multi_turn"): """Here is additional software-engineering context about this change that was not in the diff alone:

{second}

This pull request was written by an AI coding agent. AI-generated code often looks correct in isolation yet conflicts with the surrounding codebase or misreads the change's real intent -- which is only visible with this broader context.
Revisit your review using this context: add issues it reveals (inconsistency with the surrounding code, drift from the issue's intent, missing integration or tests) and drop any earlier comment it resolves. Then produce your final review.

""" + REVIEW_CONTRACT,
}
