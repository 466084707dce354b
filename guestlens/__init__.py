"""guestlens: a Spark-native analytics engine for guest-review data."""
