"""Fixed values. They are part of the data contract, so that results equal those of earlier runs."""

# Legal forms, removed from company names in this order.
LEGAL_FORMS = ("株式会社", "有限会社", "合同会社", "(株)", "(有)", "一般社団法人")

# Default discovery topics, in this order.
DEFAULT_TOPICS = (
    "新ブランド 新サービス ローンチ",
    "新規事業 新市場進出",
    "資金調達 スタートアップ 事業拡大",
    "リブランディング 理念刷新",
    "新店舗 施設 ホテル 開業",
    "周年 組織変革",
)

# Vocabularies.
FACT_TOPICS = ("company_scale", "change", "timing", "existing_expression", "sns", "production_setup")
COVERAGE_LEVELS = ("high", "medium", "low")
HUMAN_RATINGS = ("good", "maybe", "bad")

# The fifteen ratings, by stage.
STAGES = {
    "need": (
        "identity_shift",
        "narrative_strength",
        "communication_moment",
        "expression_gap",
        "visual_story_potential",
    ),
    "win": (
        "budget_likelihood",
        "procurement_access",
        "creative_investment",
        "competitive_openness",
        "proposal_fit",
    ),
    "deliver": (
        "production_scale_fit",
        "capability_fit",
        "quality_bar_fit",
        "logistics_fit",
        "operational_complexity_fit",
    ),
}

# Weights of the six legacy dimensions (they add up to 10).
DIMENSION_WEIGHTS = {
    "video_need": 2.5,
    "timing": 2.0,
    "budget_fit": 1.5,
    "studio_fit": 1.5,
    "entry_chance": 1.5,
    "location_fit": 1.0,
}

# Limits.
MAX_CANDIDATES_PER_RESPONSE = 10
OUTPUT_TRIES = 3
TRANSPORT_TRIES = 4
MESSAGE_UNITS = 1900
LOOKBACK_DAYS = 30
RANKING_NAME = "equal_stage_geometric_mean_v1"
REDACTED = "[REDACTED]"
PLACEHOLDER_SECRET = "hogehoge"

# Report wording.
REPORT_TITLE = "# Sales Report"
ERROR_TITLE = "# Sales Report Error"
LABELS = {
    "explored": "探索企業: ",
    "evaluated": "評価企業: ",
    "ranked": "Top candidates: ",
    "strategies": "戦略生成: ",
    "trigger": "営業トリガー",
    "reference_score": "参考順位点（受注確率ではありません）",
    "coverage": "根拠: ",
    "risks": "リスク",
    "follow_up": "追加確認",
    "why_now": "なぜ今",
    "proposal": "提案",
    "price": "想定価格（仮説）",
    "contact": "接触先（提案）",
    "angle": "営業の切り口",
    "strategy_failed": "戦略生成に失敗しました。DBのprocessing_errorsを確認してください。",
    "error_intro": "処理中にエラーが発生しました。",
    "bullet": "・",
}
