"""The twelve tables of the workflow: columns, keys, references and rules.

Readers take their schemas from here and the data-quality operators take their
checks from here, so a table is described once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from quillworks.functions.fixed_values import (
    APPROVAL_STATUSES,
    DEFAULT_BRAND_COLOR,
    DRAFT_STATUSES,
    EARLIEST_SCHEDULE,
    EMAIL_LIKE,
    MEMBER_ROLES,
    PLATFORMS,
    POST_STATUSES,
    SCHEDULE_STATUSES,
    USER_ROLES,
)

ID_LENGTH = 36


@dataclass(frozen=True)
class Col:
    """A column with what the database guarantees about it."""

    name: str
    type: T.DataType
    nullable: bool = False
    length: int | None = None
    domain: tuple[str, ...] | None = None
    default: str | None = None  # SQL expression


@dataclass(frozen=True)
class Reference:
    """A foreign key and what happens to the child when the parent goes."""

    column: str
    parent: str
    parent_column: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Col, ...]
    key: str
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)  # rule name -> SQL condition

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def column(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


def _id(name: str, nullable: bool = False, generated: bool = False) -> Col:
    return Col(name, T.StringType(), nullable, ID_LENGTH, default="uuid()" if generated else None)


def _text(name: str, length: int | None = None, nullable: bool = False, default: str | None = None) -> Col:
    return Col(name, T.StringType(), nullable, length, default=default)


def _enum(name: str, domain: list[str], default: str | None = None) -> Col:
    return Col(
        name, T.StringType(), False, None, tuple(domain), f"'{default}'" if default else None
    )


def _flag(name: str) -> Col:
    return Col(name, T.IntegerType(), default="1")


def _counter(name: str) -> Col:
    return Col(name, T.IntegerType(), default="0")


def _now(name: str) -> Col:
    return Col(name, T.TimestampType(), default="current_timestamp()")


def _ref(column: str, parent: str, on_delete: str, parent_column: str | None = None) -> Reference:
    return Reference(column, parent, parent_column or column, on_delete)


# Names that human beings type are compared case-, accent- and trailing-blank-insensitively.
COLLATED_COLUMNS = {"email", "client_name", "invite_code"}

_ALL = [
    Table(
        "users",
        (
            _id("user_id", generated=True),
            _text("full_name", 120),
            _text("email", 180),
            _text("password_hash", 255),
            _enum("role", USER_ROLES, "writer"),
            _now("created_at"),
        ),
        key="user_id",
        unique=(("email",),),
        rules={"email_pattern": f"email LIKE '{EMAIL_LIKE}'"},
    ),
    Table(
        "clients",
        (
            _id("client_id", generated=True),
            _text("client_name", 150),
            _text("timezone", 60, default="'UTC'"),
            _flag("active_status"),
            _now("created_at"),
        ),
        key="client_id",
        unique=(("client_name",),),
        rules={"active_flag": "active_status IN (0, 1)"},
    ),
    Table(
        "social_accounts",
        (
            _id("account_id", generated=True),
            _id("client_id"),
            _enum("platform", PLATFORMS),
            _text("account_name", 120),
            _flag("connected_status"),
            _text("buffer_profile_id", 100, nullable=True),
            _now("connected_at"),
        ),
        key="account_id",
        unique=(("client_id", "platform"),),
        references=(_ref("client_id", "clients", "cascade"),),
        rules={"connected_flag": "connected_status IN (0, 1)"},
    ),
    Table(
        "content_drafts",
        (
            _id("draft_id", generated=True),
            _id("client_id"),
            _id("created_by"),
            _text("draft_title", 200),
            _text("draft_content"),
            _enum("draft_status", DRAFT_STATUSES, "draft"),
            _now("created_at"),
        ),
        key="draft_id",
        references=(
            _ref("client_id", "clients", "cascade"),
            _ref("created_by", "users", "restrict", "user_id"),
        ),
        rules={"title_length": "char_length(draft_title) >= 3"},
    ),
    Table(
        "posts",
        (
            _id("post_id", generated=True),
            _id("draft_id"),
            _enum("platform", PLATFORMS),
            _text("repurposed_content"),
            _text("caption", nullable=True),
            _text("hashtags", nullable=True),
            _enum("status", POST_STATUSES, "pending_approval"),
            _now("created_at"),
        ),
        key="post_id",
        references=(_ref("draft_id", "content_drafts", "cascade"),),
    ),
    Table(
        "ai_generations",
        (
            _id("generation_id", generated=True),
            _id("draft_id"),
            _enum("platform", PLATFORMS),
            _text("prompt"),
            _text("generated_text"),
            _now("generated_at"),
        ),
        key="generation_id",
        references=(_ref("draft_id", "content_drafts", "cascade"),),
    ),
    Table(
        "approvals",
        (
            _id("approval_id", generated=True),
            _id("post_id"),
            _id("manager_id"),
            _enum("approval_status", APPROVAL_STATUSES),
            _text("remarks", nullable=True),
            _now("approval_date"),
        ),
        key="approval_id",
        references=(
            _ref("post_id", "posts", "cascade"),
            _ref("manager_id", "users", "restrict", "user_id"),
        ),
    ),
    Table(
        "scheduled_posts",
        (
            _id("schedule_id", generated=True),
            _id("post_id"),
            _text("buffer_update_id", 120, nullable=True),
            Col("scheduled_time", T.TimestampNTZType()),
            _enum("schedule_status", SCHEDULE_STATUSES, "pending"),
            _now("created_at"),
        ),
        key="schedule_id",
        unique=(("post_id",),),
        references=(_ref("post_id", "posts", "cascade"),),
        rules={"schedule_after_start": f"scheduled_time > TIMESTAMP_NTZ '{EARLIEST_SCHEDULE}'"},
    ),
    Table(
        "analytics_logs",
        (
            _id("analytics_id", generated=True),
            _id("post_id"),
            _counter("views"),
            _counter("likes"),
            _counter("comments"),
            _counter("shares"),
            Col("engagement_rate", T.DecimalType(5, 2), default="0.00"),
            _now("recorded_at"),
        ),
        key="analytics_id",
        references=(_ref("post_id", "posts", "cascade"),),
        rules={
            "views_not_negative": "views >= 0",
            "likes_not_negative": "likes >= 0",
            "comments_not_negative": "comments >= 0",
            "shares_not_negative": "shares >= 0",
            "rate_in_percent": "engagement_rate BETWEEN 0.00 AND 100.00",
        },
    ),
    Table(
        "content_recommendations",
        (
            _id("recommendation_id", generated=True),
            _id("client_id"),
            Col("week_start_date", T.DateType()),
            Col("week_end_date", T.DateType()),
            _enum("best_platform", PLATFORMS),
            _text("recommendation_text"),
            _now("created_at"),
        ),
        key="recommendation_id",
        unique=(("client_id", "week_start_date"),),
        references=(_ref("client_id", "clients", "cascade"),),
        rules={"week_order": "week_end_date > week_start_date"},
    ),
    Table(
        "audit_logs",
        (
            _id("log_id", generated=True),
            _id("user_id", nullable=True),
            _text("action", 100),
            _text("entity_name", 80),
            _id("entity_id", nullable=True),
            _now("created_at"),
        ),
        key="log_id",
        references=(_ref("user_id", "users", "set null"),),
    ),
    Table(
        "client_members",
        (
            _id("membership_id", generated=True),
            _id("client_id"),
            _id("user_id"),
            _enum("member_role", MEMBER_ROLES, "writer"),
            _now("added_at"),
        ),
        key="membership_id",
        unique=(("client_id", "user_id"),),
        references=(
            _ref("client_id", "clients", "cascade"),
            _ref("user_id", "users", "cascade"),
        ),
    ),
]

# Columns that brands gained after their first release.
BRAND_COLUMNS = (
    _id("owner_id", nullable=True),
    _text("industry", 100, nullable=True),
    _text("brand_voice", nullable=True),
    _text("target_audience", nullable=True),
    _text("brand_color", 7, nullable=True, default=f"'{DEFAULT_BRAND_COLOR}'"),
    _text("do_not_use", nullable=True),
    _text("invite_code", 8, nullable=True),
)
BRAND_OWNER = _ref("owner_id", "users", "set null", "user_id")
BRAND_CODE_UNIQUE = ("invite_code",)

SEED_TABLES = {table.name: table for table in _ALL}


def _evolved(table: Table) -> Table:
    if table.name != "clients":
        return table
    return Table(
        table.name,
        table.columns + BRAND_COLUMNS,
        table.key,
        table.unique + (BRAND_CODE_UNIQUE,),
        table.references + (BRAND_OWNER,),
        table.rules,
    )


TABLES = {name: _evolved(table) for name, table in SEED_TABLES.items()}
