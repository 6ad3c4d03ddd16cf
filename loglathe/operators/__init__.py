"""Table operators over events, sessions and gists."""
