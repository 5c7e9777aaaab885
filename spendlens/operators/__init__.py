"""DataFrame operators: cleaning, labelling, insights, features, metrics."""
