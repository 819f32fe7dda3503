"""Where draw records come from and go to."""
