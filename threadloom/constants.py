"""They decide results, so they are stated as they are."""

# Forum tag ids and the names shown for them.
TAG_NAMES = {
    "1006941128441999421": "Database",
    "1006941257274241114": "Auth",
    "1006941275053899887": "Edge Functions",
    "1006941348454207579": "Realtime",
    "1006941367353737366": "Storage",
    "1006941396873257041": "Migrations",
    "1006941413101015110": "Dashboard",
    "1050788587593023559": "Self-Hosting",
    "1200092227200876554": "Outage / Status",
    "1399429164783898665": "Branching",
    "1399740852930089150": "AI / Vectors",
}

# A reply with one of these marks an answered thread as resolved.
RESOLUTION_KEYWORDS = [
    "thank",
    "solved",
    "resolved",
    "fixed it",
    "worked",
    "works now",
    "perfect",
]

# Statuses and their labels.
STATUS_LABELS = {
    "likely-resolved": "Likely Resolved",
    "in-progress": "In Progress",
    "unanswered": "Unanswered",
}

# Response-time buckets, inclusive upper bounds in milliseconds.
RESPONSE_BUCKETS = [
    ("< 1h", 3_600_000),
    ("1–6h", 21_600_000),
    ("6–24h", 86_400_000),
    ("1–3d", 259_200_000),
    ("3–7d", 604_800_000),
    ("> 7d", None),
]

# Order in which sentiment groups are listed.
SENTIMENT_ORDER = ["frustrated", "resolved", "positive", "neutral", "unknown"]

# Address of a thread, and the guild used in exports.
THREAD_URL_BASE = "https://discord.com/channels"
DEFAULT_GUILD_ID = "839993398554656828"

# Columns of the CSV export.
CSV_HEADERS = [
    "id",
    "name",
    "createdAt",
    "archivedAt",
    "archived",
    "locked",
    "messageCount",
    "memberCount",
    "totalMessageSent",
    "appliedTags",
    "ownerId",
    "ownerUsername",
    "ownerGlobalName",
    "firstMessageContent",
    "firstMessageCreatedAt",
    "responseTimeMs",
    "responderCount",
    "isAnswered",
    "resolutionStatus",
    "sentiment",
    "sentimentScore",
    "sentimentSummary",
    "duplicateClusterId",
    "discordUrl",
]

# Keyword themes. Order decides, the first theme with a hit wins.
# (theme, keywords, description)
THEME_RULES = [
    (
        "Outage / Service Down",
        [
            "down", "outage", "522", "503", "500", "504", "502", "520",
            "all services are down", "service unavailable", "unavailable",
            "incident", "status page", "supabase down",
        ],
        "Reports of Supabase services being down or returning 5xx errors.",
    ),
    (
        "Network / DNS / Region",
        [
            "dns", "nxdomain", "failed to fetch", "err_name_not_resolved",
            "routing", "peering", "region", "brazil", "singapore",
            "cdn", "cloudflare", "warp", "isp", "latency", "timeout connecting",
            "network",
        ],
        "DNS, routing, region-specific, or ISP connectivity problems.",
    ),
    (
        "Auth / JWT / OAuth",
        [
            "auth", "jwt", "login", "logout", "session", "token", "oauth",
            "mfa", "2fa", "multifactor", "unauthorized", "401",
            "magic link", "otp", "verify email", "go true", "gotrue",
        ],
        "Authentication, JWT, OAuth, MFA, session, or login flow issues.",
    ),
    (
        "Database / Connectivity / Timeouts",
        [
            "database", "postgres", "pg_", "sql", "pooler", "connection pool",
            "connection terminated", "connection timeout", "pool",
            "slow query", "hangs", "hanging", "psql",
        ],
        "Database connection, pooler, query timeout, or performance issues.",
    ),
    (
        "RLS / Permissions",
        [
            "rls", "row level security", "policy", "policies", "permission denied",
            "access denied", "forbidden", "403", "role", "anon", "authenticated role",
        ],
        "Row-Level Security policy or Postgres permission issues.",
    ),
    (
        "Edge Functions",
        [
            "edge function", "edge functions", "functions", "deno", "deploy function",
            "invoke", "supabase functions", "serve", "boot",
        ],
        "Edge Function deployment, invocation, or runtime issues.",
    ),
    (
        "Migrations & Branching",
        [
            "migration", "migrations", "branch", "branching", "db pull",
            "supabase db push", "schema", "seed", "reset",
        ],
        "Database migration, schema, or Supabase branching issues.",
    ),
    (
        "Realtime / WebSockets",
        [
            "realtime", "websocket", "websockets", "subscribe", "subscription",
            "presence", "broadcast", "node.js 20", "ws package",
        ],
        "Realtime subscriptions, WebSockets, or presence issues.",
    ),
    (
        "Storage",
        [
            "storage", "bucket", "buckets", "s3", "upload", "download file",
            "presigned url", "public url", "cdn attachment",
        ],
        "Storage buckets, file uploads, or signed URL issues.",
    ),
    (
        "Billing / Plans / Quotas",
        [
            "quota", "plan", "free plan", "pro plan", "team plan", "enterprise",
            "billing", "invoice", "limit", "limits", "upgrade", "downgrade",
            "paused", "unpause", "pause", "over quota", "exceeded",
        ],
        "Plan limits, billing, paused projects, or quota-exceeded errors.",
    ),
    (
        "Dashboard / Access",
        [
            "dashboard", "cannot access", "can't access", "locked out", "locked out",
            "suspended", "lockout", "account suspended", "sign in", "sign up",
            "login page", "reset password", "forgot password",
        ],
        "Dashboard UI access, account lockout, or login page issues.",
    ),
    (
        "Vectors / AI",
        [
            "vector", "vectors", "embedding", "embeddings", "pgvector",
            "openai", "ai", "semantic search", "huggingface",
        ],
        "Vector embeddings, pgvector, or AI/search issues.",
    ),
    (
        "Compliance / Security",
        [
            "soc2", "soc 2", "audit", "pgaudit", "compliance", "hipaa",
            "gdpr", "vapt", "security review", "penetration test", "pentest",
            "cli_login_postgres", "role expired",
        ],
        "Compliance audits, security configuration, or role cleanup requests.",
    ),
    (
        "CLI / Tooling",
        [
            "cli", "supabase cli", "npm run", "bun", "yarn",
            "typescript", "ts-node", "env var", "environment variable",
        ],
        "Supabase CLI, local dev tooling, or environment configuration issues.",
    ),
    (
        "Integrations / Frameworks",
        [
            "next.js", "nextjs", "nuxt", "vercel", "netlify", "cloudflare workers",
            "react native", "flutter", "swift", "kotlin", "laravel", "python",
            "fastapi", "django", "remix", "sveltekit",
        ],
        "Issues integrating Supabase with specific frameworks or platforms.",
    ),
]
OTHER_THEME = ("Other", [], "Issues that did not match any keyword rule.")
