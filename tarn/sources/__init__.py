"""Reading source trees and change histories into tables."""
