"""Column lists of the tables handed between pipeline stages."""

SENTIMENT_RESULTS_COLUMNS = (
    "ticker", "created_utc", "final_sentiment_score", "normalized_upvotes",
    "final_sentiment_label", "source_model", "tw_confidence", "subreddit",
    "type", "text_length", "word_count",
)

SENTIMENT_DAILY_COLUMNS = (
    "ticker", "sentiment_date", "sentiment_mean", "sentiment_median", "sentiment_std",
    "mentions", "total_upvotes", "avg_upvotes", "weighted_sentiment",
    "positive_count", "neutral_count", "negative_count",
)

SIGNAL_COLUMNS = (
    "signal_date", "ticker", "sentiment_mean", "total_upvotes", "window_sentiment",
    "window_mentions", "baseline_mean", "baseline_std", "z_score", "signal_type",
    "signal_direction", "signal_score",
)

MARKET_COLUMNS = (
    "pct_change_3d", "pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_14", "atr_move",
)

FILTERED_SIGNAL_COLUMNS = SIGNAL_COLUMNS + ("target_date",) + MARKET_COLUMNS + ("market_moved_flag",)

# Required columns of a signal table (schema check P17).
REQUIRED_SIGNAL_COLUMNS = (
    "signal_date", "ticker", "signal_type", "window_sentiment", "window_mentions",
    "baseline_mean", "baseline_std", "z_score", "signal_score",
)

PREPROCESSED_COLUMNS = (
    "id", "sentiment_ready_text", "type", "subreddit", "created_utc", "normalized_upvotes",
    "mentioned_tickers", "n_tickers", "text_length", "word_count", "date", "hour", "day_of_week",
)
