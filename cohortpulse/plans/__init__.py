"""The school data set: cleaning, features, story queries, dashboard measures."""
