"""Fixed values of the workflow.

Everything in this file is a value that must be exactly as given for results to
be right: enum domains, defaults, limits, prompt wording, phrase lists. There is
no logic here.
"""

# Enum domains, in their declared order.
USER_ROLES = ["writer", "manager", "admin", "client"]
PLATFORMS = ["instagram", "linkedin", "facebook", "twitter", "tiktok", "youtube"]
DRAFT_STATUSES = ["draft", "submitted", "repurposed", "archived"]
POST_STATUSES = [
    "pending_approval",
    "approved",
    "rejected",
    "request_edit",
    "scheduled",
    "published",
]
APPROVAL_STATUSES = ["approved", "rejected", "request_edit"]
SCHEDULE_STATUSES = ["pending", "sent", "failed", "cancelled"]
MEMBER_ROLES = ["writer", "manager"]
DECIDER_ROLES = ["manager", "admin"]
REVEAL_REMARKS_STATUSES = ["rejected", "request_edit"]

# Display names of the platforms on the accounts screen, in screen order.
PLATFORM_NAMES = {
    "instagram": "Instagram",
    "linkedin": "LinkedIn",
    "twitter": "Twitter / X",
    "facebook": "Facebook",
    "tiktok": "TikTok",
    "youtube": "YouTube",
}

# Defaults, labels and limits.
DEFAULT_BRAND_COLOR = "#0a0a0a"
NO_CLIENT = "No client"
NO_INDUSTRY = "No industry set"
NO_BEST_PLATFORM = "None yet"
PREVIEW_CHARACTERS = 120
TOP_POSTS = 5
RECENT_DRAFTS = 5
DRAFTS_PAGE = 50
TOP_BRANDS = 5
NEWEST_APPROVED = 3
STALE_AFTER_DAYS = 7
RETENTION_DAYS = 60
MIN_TITLE_CHARACTERS = 3
MIN_CONTENT_CHARACTERS = 20
MIN_BRAND_NAME_CHARACTERS = 2
MIN_HANDLE_CHARACTERS = 2
INVITE_CODE_PATTERN = "^[A-Z0-9]{6}$"
EMAIL_LIKE = "%@%.%"
EARLIEST_SCHEDULE = "2024-01-01 00:00:00"
RATE_TOLERANCE = "0.01"

# The characters that str.strip() removes in Python.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Writing rules per platform, quoted in the prompt. A platform
# without rules uses those of DEFAULT_RULES_PLATFORM.
DEFAULT_RULES_PLATFORM = "instagram"
PLATFORM_RULES = {
    "instagram": {
        "tone": (
            "Warm, personal, and real — like a friend sharing something that genuinely moved them. "
            "Write in first person. Speak directly to the reader. Be specific, not vague."
        ),
        "format": (
            "Start with a one-line hook that stops the scroll — a surprising fact, a short question, or a bold statement. "
            "Write 150-200 words. Use short sentences. Break lines for readability. "
            "Use 2-3 emojis placed naturally, not at every line. End with a clear call to action or a question. "
            "Do NOT include any hashtags inside the post body — they go in the hashtags field only."
        ),
        "storytelling": (
            "Open with a specific moment or observation. Build a small tension. Land on a useful insight or feeling. "
            "Do NOT describe or reference any image, photo, or visual. Write purely as text copy."
        ),
        "hashtag_count": "8-10 relevant hashtags",
    },
    "linkedin": {
        "tone": (
            "Confident but humble — like a mentor sharing a real lesson they learned the hard way. "
            "Write like a person, not a brand. Be direct and honest. Show a point of view."
        ),
        "format": (
            "Start with a single bold line that earns the click to 'see more'. "
            "Use short paragraphs — 1 to 2 sentences each. Write 200-300 words. "
            "End with a genuine question that invites real replies. "
            "Do NOT include any hashtags inside the post body — they go in the hashtags field only."
        ),
        "storytelling": (
            "Open with a specific moment, number, or turning point — not a broad claim. "
            "Move from problem to lesson to takeaway. Make the reader feel the insight, not just read it."
        ),
        "hashtag_count": "3-5 professional hashtags",
    },
    "twitter": {
        "tone": (
            "Sharp, direct, and a little opinionated — like a smart friend sending you a text they couldn't keep to themselves. "
            "Write one clear idea. No throat-clearing. No buildup."
        ),
        "format": (
            "Keep the post body under 240 characters — leave room for hashtags. "
            "Make it punchy and quotable. Use plain language. "
            "End with a short question or a line that makes people want to reply. "
            "Do NOT include any hashtags inside the post body — they go in the hashtags field only."
        ),
        "storytelling": (
            "One idea. One punch. The best tweets sound like something you wish you'd said first."
        ),
        "hashtag_count": "2-3 tight, relevant hashtags",
    },
    "facebook": {
        "tone": (
            "Warm and conversational — like telling a story at the dinner table to people you actually like. "
            "Relatable, grounded, and a little bit personal. Write like a real human, not a marketer."
        ),
        "format": (
            "Write 100-150 words. Use simple, short sentences. "
            "Open with a line that makes someone stop scrolling. End with a question that feels natural, not forced. "
            "Do NOT include any hashtags inside the post body — they go in the hashtags field only."
        ),
        "storytelling": (
            "Share something specific and real. A moment, a realization, a small story with a payoff. "
            "Avoid generic observations. Make the reader nod and say 'same'."
        ),
        "hashtag_count": "3-4 broad hashtags",
    },
}

# The length limits that the rules above state.
WORD_LIMITS = {"instagram": (150, 200), "linkedin": (200, 300), "facebook": (100, 150)}
CHARACTER_LIMITS = {"twitter": 240}

# Phrases that a post must not use.
BANNED_PHRASES = [
    "game-changer",
    "leverage",
    "synergy",
    "unlock",
    "dive deep",
    "it's no secret",
    "the reality is",
    "cutting-edge",
    "innovative",
    "transform",
    "revolutionize",
    "in today's fast-paced world",
    "groundbreaking",
    "seamlessly",
    "robust",
    "testament",
    "pivotal",
    "navigate",
    "landscape",
    "delve",
    "empower",
    "foster",
    "elevate",
    "crucial",
    "utilize",
    "facilitate",
    "in conclusion",
    "at the end of the day",
]

# Wording of the prompt.
PROMPT_OPENING = "You are a social media expert writing content for a specific brand.\n\n"
PROMPT_WRITING_RULES = (
    "WRITING RULES — follow these strictly:\n"
    "- Write like a real person. Use simple, everyday English. Short sentences win.\n"
    "- Be a storyteller first, copywriter second. Every good post has a hook, a tension, and a payoff.\n"
    "- NEVER use these overused AI words or phrases: game-changer, leverage, synergy, unlock, dive deep, "
    "  it's no secret, the reality is, cutting-edge, innovative, transform, revolutionize, in today's fast-paced world, "
    "  groundbreaking, seamlessly, robust, testament, pivotal, navigate, landscape, delve, empower, "
    "  foster, elevate, crucial, utilize, facilitate, in conclusion, at the end of the day.\n"
    "- Avoid stacking adjectives. One strong word beats three weak ones.\n"
    "- Do NOT reference, describe, or suggest any image, stock photo, or visual element.\n"
    "- Do NOT write captions that sound like they belong under a generic stock photo.\n"
    "- Write in active voice. Passive voice makes copy feel slow and corporate.\n"
    "- Be specific. 'I lost 3 clients in one week' beats 'I faced some challenges'.\n"
    "- Sound like a smart human, not an AI trying to sound human.\n"
)
PROMPT_CLOSING = (
    "CRITICAL RULES:\n"
    "1. Match the BRAND VOICE exactly — this is more important than anything else\n"
    "2. Write FOR the target audience, not at them\n"
    '3. Strictly avoid anything in "AVOID THESE"\n'
    "4. Output ONLY a JSON object, nothing else\n"
    "5. Do NOT use markdown code blocks\n"
    '6. Inside JSON strings, escape any double quotes with \\"\n'
    '7. The "repurposed_content" must be COMPLETE — do not cut it short\n'
    "8. Start your response with { and end with }\n"
    "\n"
    "Required JSON format:\n"
    "{\n"
    '  "repurposed_content": "the COMPLETE post text",\n'
    '  "caption": "the hook or short caption",\n'
    '  "hashtags": "space-separated hashtags starting with #"\n'
    "}"
)

# Texts of the weekly recommendation.
STARTER_RECOMMENDATION = (
    "Start by creating your first few posts. Once you have engagement data, "
    "we'll give you personalized recommendations."
)
STARTER_PLATFORM = "instagram"
SUMMARY_PROMPT_OPENING = (
    "You are a social media strategist analyzing weekly analytics.\n\nWEEKLY DATA:\n"
)
SUMMARY_PROMPT_CLOSING = (
    "\n\nBased on this data, write 2-3 specific actionable recommendations for next week. Be concrete:\n"
    "- Which platform to focus on\n"
    "- What type of content performs best there\n"
    "- Optimal posting frequency\n"
    "\n"
    "Keep it under 80 words. Direct, data-driven tone. No fluff."
)
FALLBACK_BEFORE_PLATFORM = "Focus on "
FALLBACK_AFTER_PLATFORM = (
    " next week — it's your highest-engagement platform. Aim for 3-4 quality posts."
)

# Lines of the null report, each with its label, table and column.
NULL_CHECKS = [
    ("users - NULL email", "users", "email"),
    ("drafts - NULL created_by", "content_drafts", "created_by"),
    ("drafts - NULL client_id", "content_drafts", "client_id"),
    ("posts - NULL draft_id", "posts", "draft_id"),
    ("approvals - NULL post_id", "approvals", "post_id"),
    ("approvals - NULL manager", "approvals", "manager_id"),
    ("analytics - NULL engagement", "analytics_logs", "engagement_rate"),
    ("scheduled - NULL time", "scheduled_posts", "scheduled_time"),
]

# Lines of the orphan report, each with its label, table and referring column.
ORPHAN_CHECKS = [
    ("orphan posts (no draft)", "posts", "draft_id"),
    ("orphan approvals (no post)", "approvals", "post_id"),
    ("orphan approvals (no manager)", "approvals", "manager_id"),
    ("orphan scheduled (no post)", "scheduled_posts", "post_id"),
    ("orphan analytics (no post)", "analytics_logs", "post_id"),
    ("orphan social (no client)", "social_accounts", "client_id"),
    ("orphan drafts (no client)", "content_drafts", "client_id"),
]
